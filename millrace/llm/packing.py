"""Operator 5, best-fit packing of documents into sequences of fixed length.

Best-fit decreasing looks only at lengths, and a piece has at most max_len tokens. So the whole
plan follows from how many pieces there are of each length: at most max_len numbers, whatever the
size of the table. The driver plays best-fit decreasing over them: a segment tree over remaining
capacities finds the tightest open bin in logarithmic time, and equal pieces that go to equally
full bins are placed in one step, as a run. Runs are intervals of bin numbers; their number
depends on max_len, not on the number of documents. The pieces of each length are numbered in
parallel (a count for each length and hash bucket, then row numbers inside the buckets, so that a
length that a third of all pieces share is spread), and each looks up its run by binary search.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import parts, small, table, written
from millrace.llm.tokens import default_tokenizer, encoder


class CapacityTree:
    """A segment tree over capacities 0..most; a node knows whether a bin is open below it."""

    def __init__(self, most: int):
        self.size = 1 << (most + 1).bit_length()
        self.open = bytearray(2 * self.size)

    def mark(self, capacity: int, is_open: bool) -> None:
        k = self.size + capacity
        self.open[k] = is_open
        while k > 1:
            k >>= 1
            self.open[k] = self.open[2 * k] | self.open[2 * k + 1]

    def tightest(self, need: int) -> int | None:
        """The least capacity of need or more with an open bin."""
        k = self.size + need
        if self.open[k]:
            return need
        while k > 1:
            if not k & 1 and self.open[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k + (not self.open[2 * k])
                return k - self.size
            k >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], max_len: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first bin, offset) sorted by length and rank, and the number of bins."""
    tree, by_room, runs, bins = CapacityTree(max_len), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            if not by_room.get(room):
                tree.mark(room, True)
            by_room.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = max_len, bins, -(-left // (max_len // length))
                bins += n
            else:
                first, n = by_room[room].pop()
                if not by_room[room]:
                    tree.mark(room, False)
            each = room // length  # a bin that got a piece is the tightest one for the next
            whole = min(n, left // each)
            for j in range(each if whole else 0):
                runs.append((length, rank, whole, first, max_len - room + j * length))
                rank += whole
            left -= whole * each
            used = whole
            if whole < n and left:  # fewer than `each` remain: they share one bin
                for j in range(left):
                    runs.append((length, rank, 1, first + whole, max_len - room + j * length))
                    rank += 1
                put(room - left * length, first + whole, 1)
                left, used = 0, whole + 1
            put(room - each * length, first, whole)
            put(room, first + used, n - used)
    runs.sort()
    return np.array(runs, dtype=np.int64).reshape(-1, 5), bins


def cut(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole max_len pieces behind a shorter first one."""
    first = n % max_len or max_len
    return [(0, min(n, first)), *((s, max_len) for s in range(first, n, max_len))] if n else []


def pieces(docs: DataFrame, max_len: int = 2048, tokenizer: str | None = None, end_id: int | None = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32 bit, if asked for) of every document.

    A null text is empty: with an end id it makes one piece of that id, without one no piece. Null
    and repeated ids are kept as they are. Other columns are left alone.
    """
    model = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def encode(batches):
        import pyarrow as pa

        enc = encoder(model)
        tail = b"" if end_id is None else np.array([end_id], dtype=enc.dtype).tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for batch in small(batches):
            rows = []
            for doc_id, text in zip(batch["k"].to_pylist(), batch["t"].to_pylist()):
                ids = np.frombuffer(enc.ids(text) + tail, dtype=enc.dtype).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), max_len)):
                    b = ids[s : s + n].tobytes()
                    rows.append((doc_id, k, s, n, zlib.crc32(b), *[b] * with_ids))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(encode, schema)


def pack(cut_pieces: DataFrame, max_len: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a table with doc_id, piece, ids_crc32 and length (1..max_len).

    Columns named sequence_id, offset, _bucket, _n, _before or _rank are replaced or dropped. Bins hold at most max_len, without gaps. Equal rows are interchangeable. An empty table stays
    empty. The driver reads one count for each length.
    """
    spark, cut_pieces = cut_pieces.sparkSession, cut_pieces.drop("sequence_id", "offset", "_bucket", "_n", "_before", "_rank")
    counts = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}
    runs, _ = best_fit_decreasing(counts, max_len)
    plan = spark.sparkContext.broadcast(runs)  # bounded by max_len

    bucketed = cut_pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * parts(spark))))
    tally = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = tally.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(order) - 1).drop("_bucket", "_before")

    def place(batches):
        import pyarrow as pa

        runs = plan.value
        keys = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            run = runs[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            kept = [(n, batch[n]) for n in batch.schema.names if n != "_rank"]
            out = kept + [("sequence_id", pa.array(run[:, 3] + rank - run[:, 1])), ("offset", pa.array(run[:, 4]))]
            yield pa.RecordBatch.from_arrays([c for _, c in out], [n for n, _ in out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, n_tokens, ids (binary), doc_ids."""
    got = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length"))).alias("p"))
    return got.select("sequence_id", F.expr("aggregate(p, 0L, (a, x) -> a + x.length)").alias("n_tokens"), F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.expr("transform(p, x -> x.doc_id)").alias("doc_ids"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place: see the module."""
    docs = table(spark, sf_dir, "documents")
    return pack(written(pieces(docs, 2048), "pieces"), 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
