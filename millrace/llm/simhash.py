"""Operator 2, SimHash near-duplicates.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 values of a text's word
shingles. Fingerprints within `bits` differing bits link. They are cut into bits + 2 blocks: two
that differ in at most `bits` bits agree in two whole blocks at least, so they meet in one of the
tables keyed by a pair of blocks; candidates that share a key are verified by their Hamming
distance. Exact copies share a fingerprint and are one row before any join.

A key that more than MOST different fingerprints share would make too many pairs. Its
fingerprints are linked otherwise, without loss: two fingerprints are within two bits exactly if
some number is within one bit of both, so each is sent to the 65 numbers within one bit, and all
that meet there (65 at most) link to the least one. That way holds for bits = 2; other
values take the pairs of every key.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import forget, small, table, with_rank, written
from millrace.llm.graph import connected_components

MOST = 64


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned number; 0 without words. Only A-Z are lower-cased; words part at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(n)))) if len(words) > n else [b" ".join(words)]
    return majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (to find the row again), fp (signed) of every row; a null text has fingerprint zero."""

    def run(batches):
        import pyarrow as pa

        for batch in small(batches):
            fps = np.fromiter((fingerprint(t, n, seed) for t in batch["t"].to_pylist()), dtype=np.uint64, count=batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(fps)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def block_masks(bits: int) -> list[int]:
    """For each pair of the bits + 2 blocks, a signed mask with ones in the two."""
    count = bits + 2
    edges = [64 * k // count for k in range(count + 1)]
    ones = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [int(np.uint64(ones[i] | ones[j]).astype(np.int64)) for i, j in combinations(range(count), 2)]


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints whose components are those of all pairs within `bits` bits.

    fps: one row a fingerprint, column fp.
    """
    keys = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(block_masks(bits))))
    rows = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.key")
    shared = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = written(rows.join(shared, ["t", "key"]), "blocks")  # those alone under their key are gone
    few = rows.where(F.col("n") <= MOST) if bits == 2 else rows
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")))
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    if bits != 2:
        return pairs
    crowded = rows.where(F.col("n") > MOST).select("fp").distinct()
    near = crowded.select("fp", F.explode(F.expr("transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))")).alias("middle"))
    stars = near.select("fp", F.min("fp").over(Window.partitionBy("middle")).alias("a")).where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars)


def components(rows: DataFrame, bits: int = 2) -> DataFrame:
    """fp, component_id, first_hash of every fingerprint in a table of fingerprints().

    component_id is the least doc_id of its component (null ids don't count unless there are no
    others), first_hash the least text_hash among that id's rows in it.
    """
    distinct = written(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("first")), "distinct")
    linked = connected_components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    labelled = distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = labelled.groupBy("component").agg(F.min("first").alias("least"))
    return labelled.join(first, "component").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("first_hash"))


def near_duplicates(docs: DataFrame, n: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row.

    Null and empty texts have fingerprint zero and link like others; repeated rows each get a row;
    an empty table gives none; other columns are left alone.
    """
    rows = written(fingerprints(docs, n, id_col=id_col, text_col=text_col), "fingerprints")
    return rows.join(components(rows, bits), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, n: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that come first in their component: one row of each. Of rows that repeat id and text, the one whose columns have the least hash."""
    rows = written(fingerprints(docs, n, id_col=id_col, text_col=text_col), "fingerprints")
    firsts = written(components(rows, bits).select(F.col("component_id").alias("_id"), F.col("first_hash").alias("_hash")).distinct(), "firsts")
    forget(rows)
    keep = with_rank(docs, id_col, text_col).alias("d").join(firsts.alias("f"), F.col("d._id").eqNullSafe(F.col("f._id")) & (F.col("d._hash") == F.col("f._hash")), "left_semi")
    return keep.groupBy("_id", "_hash").agg(F.min_by("row", "_rank").alias("row")).select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at two or fewer differing bits, over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
