"""Exact byte-level BPE ids of whole texts through the tokenizers library, with a cache of words.

A byte-level tokenizer first cuts a text into words by a pattern and then merges bytes inside
each word, so the ids of a text are the ids of its words, joined. Between a non-space character
and a single blank that a non-space character follows there is always such a cut, whatever
stands around it. So a text is cut at these blanks, and the pieces, which repeat, are looked up
in a cache; a new piece is cut into words by the pattern, and a new word is merged by the
library's own model. Pieces with characters beyond ASCII and the Latin-1 letters go to the
library whole, as do texts that hold the string of an added token (such as the end-of-text mark,
which the library makes one id), and all texts if the tokenizer isn't of this kind.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_CUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+").findall
_PLAIN = re.compile(rf"[\n\t -~{_L}]+").fullmatch
_BOUNDS = re.compile(r"(?<=\S)(?= \S)").split


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Texts to ids. words, pieces: most entries of the two caches, which are emptied when full."""

    def __init__(self, path: str, words: int = 700_000, pieces: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.fast = (
            spec.get("normalizer") is None and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and (spec.get("truncation"), spec.get("padding")) == (None, None)
        )
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self._merge, self._chars = self.tok.model.tokenize, _byte_chars()
        self._words: dict[str, bytes] = {}
        self._mid: dict[str, bytes] = {}
        self._most = words, pieces
        back = {c: b for b, c in self._chars.items()}
        self.byte_length = np.zeros(self.tok.get_vocab_size(), dtype=np.int64)  # of each id
        for s, i in self.tok.get_vocab().items():
            self.byte_length[i] = len(s) if all(c in back for c in s) else len(s.encode())

    def _library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not _PLAIN(chunk):
            return self._library(chunk)
        known, out = self._words, []
        for w in _CUT(chunk):
            b = known.get(w)
            if b is None:
                if len(known) >= self._most[0]:
                    known.clear()
                ids = [t.id for t in self._merge(w.encode().decode("latin-1").translate(self._chars))]
                b = known[w] = np.array(ids, dtype=self.dtype).tobytes()
            out.append(b)
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian integers of self.dtype; null: as empty."""
        if not text:
            return b""
        if not self.fast or any(a in text for a in self.added):
            return self._library(text)
        head, *rest = text.split(" ")
        mid = self._mid
        if not head or head[0].isspace() or head[-1].isspace():
            return b"".join(map(self._chunk, _BOUNDS(text)))
        try:
            return self._chunk(head) + b"".join([mid[p] for p in rest])
        except KeyError:
            pass
        if len(mid) >= self._most[1]:
            mid.clear()
        for p in rest:
            if p not in mid:
                if not p or p[0].isspace() or p[-1].isspace():
                    return b"".join(map(self._chunk, _BOUNDS(text)))
                mid[p] = self._chunk(" " + p)
        return self._chunk(head) + b"".join([mid[p] for p in rest])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One Encoder a worker process: its caches live as long as the worker."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
