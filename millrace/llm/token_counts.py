"""Operator 8, token counts of sections by character offsets.

Each document is encoded once, whole. A byte-level vocabulary loses nothing, so the running sum of
the tokens' byte lengths gives every token's byte span, and from it the span of characters that it
touches. Sections are intervals of characters that cover the text: each ends behind its
separator. Both lists are sorted, so they are joined by one search. A token that crosses a
boundary is counted once, by the rule named:

* "first": for the section of its first character,
* "last": for the section of its last character,
* "most": for the section with most of its characters, the earlier one on a tie.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.llm.tokens import default_tokenizer, encoder


def token_spans(data: bytes, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token; a character whose bytes are split touches several tokens."""
    end = np.cumsum(byte_lengths)
    start = end - byte_lengths
    if data.isascii():
        return start, end
    char = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    return char[start] - 1, char[end - 1]


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token. sections: first character of each, ascending from 0."""
    first = np.searchsorted(sections, start, side="right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(sections, end - 1, side="right") - 1
    if rule == "last":
        return last
    out = first.copy()
    for k in np.flatnonzero(first != last):
        edges = np.array([start[k], *sections[first[k] + 1 : last[k] + 1], end[k]])
        out[k] = first[k] + int(np.argmax(np.diff(edges)))
    return out


def section_token_counts(docs: DataFrame, separator: str = r"\n", rule: str = "most", tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section (from 0), char_start, char_end, n_tokens, n_crossing (of these, tokens that cross a boundary).

    A section ends behind a match of separator. A null or empty text has one empty section. Rows
    that repeat an id, and null ids, give rows of their own. Other columns are left alone.
    """
    if rule not in ("first", "last", "most"):
        raise ValueError(f"no such rule: {rule}")
    model = tokenizer or default_tokenizer()

    def count(batches):
        import pyarrow as pa

        enc, breaks = encoder(model), re.compile(separator).finditer
        for batch in batches:
            cols = [[], [], [], [], [], []]
            for doc_id, text in zip(batch["k"].to_pylist(), batch["t"].to_pylist()):
                text = text or ""
                edges = np.array([0, *(m.end() for m in breaks(text) if 0 < m.end() < len(text))], dtype=np.int64)
                n = np.zeros(len(edges), dtype=np.int64)
                crossing = n
                if text:
                    ids = np.frombuffer(enc.ids(text), dtype=enc.dtype)
                    start, end = token_spans(text.encode(), enc.byte_length[ids])
                    at = attribute(start, end, edges, rule)
                    n = np.bincount(at, minlength=len(edges))
                    crosses = (start < edges[at]) | (end > np.append(edges[1:], len(text))[at])
                    crossing = np.bincount(at[crosses], minlength=len(edges))
                for c, x in zip(cols, ([doc_id] * len(edges), range(len(edges)), edges.tolist(), [*edges[1:].tolist(), len(text)], n.tolist(), crossing.tolist())):
                    c.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    schema = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long"
    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(count, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_token_counts(table(spark, sf_dir, "documents"))
