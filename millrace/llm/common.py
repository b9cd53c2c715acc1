"""The worker-side helpers of the training-data operators; with the shared folder and written tables of millrace.shared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.shared import forget, fresh_path, qualified, shared_dir, written  # noqa: F401

#: White space of the contracts: [\x20\x09-\x0D]; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def open_fs(path: str):
    """A pyarrow file system and the path in it, on the driver or in a worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def small(batches, rows: int = 256):
    """Arrow batches in slices, so that few texts are Python strings at once."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def give_back() -> None:
    """Gives memory that fitting has left free back to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fresh_worker() -> None:
    """Lets go of what tasks of other stages have kept in this worker process: the tokenizer's caches and free memory."""
    from millrace.llm.tokens import encoder

    encoder.cache_clear()
    give_back()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, mod: int):
    """crc32 of an id as text, modulo mod: the split of labelled rows into learned and held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


MOST_BROADCAST = 200_000  # rows of ids and hashes


def sample_texts(docs: DataFrame, learn: DataFrame, by: str, most: int, seed: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """At most `most` distinct texts of each value of `by`, whole, as (by, doc_id, _h, text); and (by, n) with the rows there are.

    learn: (by, doc_id, _h) of the rows to draw from, _h the hash of the text by hashed(). Copies are
    one text, the likelier drawn the more there are: the draw takes the least of -ln(u) / copies, u by
    hash, so one text that makes up a label is never missed and never fills the sample either.
    """
    texts = written(learn.groupBy(by, "_h").agg(F.count("*").alias("_n"), F.min("doc_id").alias("doc_id")), "texts")
    totals = written(texts.groupBy(by).agg(F.sum("_n").alias("n"), F.count("*").alias("_t")), "totals")
    counts = totals.withColumnRenamed(by, "_by")
    counts = F.broadcast(counts) if totals.count() <= MOST_BROADCAST else counts  # else a join would deal all texts of a value to one task
    u = (F.pmod(F.xxhash64(F.lit(seed), "_h"), F.lit(2**52)) + 0.5) / 2.0**52
    keyed = texts.withColumn("_key", -F.log(u) / F.col("_n")).join(counts, F.col(by) == F.col("_by"))
    share = 1.5 * most / F.col("_t")  # keys up to here belong to this share of the texts at least: no value of `by` is sorted whole
    near = keyed.where((share >= 1) | (F.col("_key") <= -F.log(1 - F.least(share, F.lit(1 - 1e-9)))))
    first = F.row_number().over(Window.partitionBy(by).orderBy("_key", "_h"))
    ids = written(near.withColumn("_k", first).where(F.col("_k") <= most).select(by, F.col("doc_id").alias("_d"), F.col("_h").alias("_g")), "sample")
    few = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    got = hashed(docs, text_col).join(few, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")))
    return got.select(by, "doc_id", "_h", "text").dropDuplicates([by, "doc_id", "_h"]), totals.select(by, "n")


def hashed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and its hash _h."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"))


def with_rank(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _hash (of the text), row (all columns), _rank: a hash of the columns, for a choice among rows that repeat id and text."""
    rank = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), rank.alias("_rank"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"))
