"""Operators 1, 5 and 8: the same ids as the library, round trips and packing against plain versions."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing, sstable, token_counts
from millrace.llm.tokens import default_tokenizer, encoder

SCHEMA = "doc_id long, text string, k string, t int, h double, sequence_id string, _bucket int"
ODD = [(None, "null id"), (3, None), (4, ""), (1, "one two  three"), (1, "again"), (1, "again"), (-7, "é ½ 🙂<|endoftext|> \x1c x"), (9, "long " * 20_000), (10, " lead and trail \n")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, 0.5, "s", 2) for i, t in ODD], SCHEMA)


FRESH = Tokenizer.from_file(default_tokenizer())  # as the contract calls it, apart from the encoder's


def library(text):
    return [*FRESH.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_the_librarys():
    enc, rng = encoder(default_tokenizer()), random.Random(3)
    texts = ["".join(rng.choice(" \n\t'sé1½ a.,—\x1c🙂ΩreI'll") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    marks = ["<|endoftext|>", " <|endoftext|> x", "a b<|endoftext|>", "<|endoftext|><|endoftext|>", "plain <|endoftext| > <|end", "é <|endoftext|>\n\n the"]
    for t in texts + [t or "" for _, t in ODD] + marks:
        assert np.frombuffer(enc.ids(t), enc.dtype).tolist() == library(t)[:-1], repr(t)


def test_shards_round_trip(spark, odd):
    shards = sstable.write_shards(odd, shard_bytes=400)
    rows = shards.read(spark).collect()
    want = sorted(((i, library(t)) for i, t in ODD), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [i for i, _ in want]
    for i, t in ODD:
        assert library(t) in [x.tolist() for x in shards.get(i)]
    assert shards.get(123456) == [] and len(shards.get(1)) == 3
    assert sstable.Shards.open(shards.path) == shards


def test_shards_share_no_key_and_keep_no_other_file(spark, odd, tmp_path):
    """Rows of one id that different tasks write; files of an attempt that didn't count."""
    many = spark.createDataFrame([(5, f"text {k % 900}") for k in range(1000)] + [(None, f"null {k}") for k in range(500)], "doc_id long, text string")
    path = f"file://{tmp_path}/sst"
    (tmp_path / "sst").mkdir()
    (tmp_path / "sst" / "shard-000000-0000-lost.sst").write_bytes(b"half")
    shards = sstable.write_shards(many, path=path, shard_bytes=600)
    keys = [k for p, *_ in shards.shards for b in range(len(sstable.Reader(p).index)) for k, _ in sstable.Reader(p)._scan(sstable.Reader(p)._block(b)[0], 0)]
    assert len(shards.shards) >= 8 and keys == sorted(set(keys)) and len(keys) == 1500
    assert len(shards.get(5)) == 1000 and len(shards.get(None)) == 500
    assert sorted(f.name for f in (tmp_path / "sst").glob("*.sst")) == sorted(p.rsplit("/", 1)[1] for p, *_ in shards.shards)


def test_shards_of_nothing(spark, odd):
    assert sstable.write_shards(odd.limit(0)).read(spark).count() == 0


def test_shard_lookup_over_blocks(spark):
    docs = spark.createDataFrame([(i * 3, f"word{i} " * 50) for i in range(3000)], "doc_id long, text string")
    shards = sstable.write_shards(docs)
    for i in (0, 3, 1500, 8997):
        assert shards.get(i)[0].tolist() == library(f"word{i // 3} " * 50)
    assert not shards.get(1) and not shards.get(9000)


def plain_best_fit(lengths, cap):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(cap - n)
    return sorted(rooms)


def test_best_fit_decreasing_is_the_plain_one():
    rng = random.Random(1)
    for cap in (1, 7, 30, 64):
        for _ in range(60):
            lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 60))]
            runs, bins = packing.best_fit_decreasing({n: lengths.count(n) for n in set(lengths)}, cap)
            rooms, placed = [cap] * bins, []
            for length, rank, n, first, offset in runs.tolist():
                for k in range(n):
                    rooms[first + k] -= length
                    placed.append((first + k, offset, length))
            assert sorted(rooms) == plain_best_fit(lengths, cap)
            ends = {}
            for b, offset, length in sorted(placed):
                assert ends.get(b, 0) == offset
                ends[b] = offset + length


def test_packing_odd_rows(spark, odd):
    cut = packing.pieces(odd, 64, with_ids=True)
    rows = packing.pack(cut.withColumn("_bucket", cut.length), 64).collect()
    assert len(rows) == cut.count()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    whole = [r for r in rows if r.doc_id == 9]
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(whole, key=lambda r: r.piece)])
    assert ids.tolist() == library("long " * 20_000) and all(r.length == 64 for r in whole if r.piece)
    out = packing.sequences(packing.pack(cut, 64)).collect()
    assert sum(r.n_tokens for r in out) == sum(r.length for r in rows) and all(len(r.ids) == 4 * r.n_tokens <= 256 for r in out)
    assert packing.pack(packing.pieces(odd.limit(0))).count() == 0


def test_section_counts_add_up(spark, odd):
    enc = encoder(default_tokenizer())
    for rule in ("first", "last", "most"):
        rows = token_counts.section_token_counts(odd, r"[. ]", rule).collect()
        for i, t in ODD:
            if [x for x, _ in ODD].count(i) == 1:
                own = [r for r in rows if r.doc_id == i]
                assert sum(r.n_tokens for r in own) == len(library(t)) - 1
                assert own and max(r.char_end for r in own) == len(t or "")
    assert token_counts.section_token_counts(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_token_counts(odd, rule="none")
    # against the library's own offsets
    text = "ab cd.\nefé gh\n\nij 🙂 k\nl"
    e = enc.tok.encode(text, add_special_tokens=False)
    start, end = token_counts.token_spans(text.encode(), enc.byte_length[np.array(e.ids)])
    assert list(zip(start.tolist(), end.tolist())) == e.offsets


def test_crossing_tokens_follow_the_rule():
    start, end, edges = np.array([0, 2, 6]), np.array([2, 6, 8]), np.array([0, 3, 5])
    assert token_counts.attribute(start, end, edges, "first").tolist() == [0, 0, 2]
    assert token_counts.attribute(start, end, edges, "last").tolist() == [0, 2, 2]
    assert token_counts.attribute(start, end, edges, "most").tolist() == [0, 1, 2]
