"""Seeded orders, prefixes, shards and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int | str, *ids: str) -> Column:
    """An order that looks random and only depends on the seed and the ids."""
    return F.xxhash64(F.lit(str(seed)), *ids)


def first_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of an order: each task keeps n at most."""
    return df.orderBy(*order).limit(n)


def per_group(df: DataFrame, group: list[str], n: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def train_val(df: DataFrame, val_size: int, *order: Column | str) -> DataFrame:
    """Adds split: the first val_size rows of the order are 'val'. The cut is one row's place, found by a top-n."""
    named = df.withColumn("_o", F.struct(*order))
    edge = named.select("_o").orderBy("_o").limit(val_size).agg(F.max("_o").alias("_edge"))
    return named.join(F.broadcast(edge)).withColumn("split", F.when(F.col("_o") <= F.col("_edge"), "val").otherwise("train")).drop("_o", "_edge")


def place(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds place, 0, 1, ... in the order: ranges of it are numbered in parallel behind the counts of those before."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ranged = ranged.persist()
    before = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n"))
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("place", F.col("_before") + within).drop("_p", "_m", "_before")


def stage_order(df: DataFrame, mode: str, bench: str, seed: int, limit: int = 0, id_col: str = "id", pos: str = "pos") -> DataFrame:
    """Letter stages keep file order; reasoning stages a seeded one, cut to a prefix (0: all)."""
    order = [F.col(pos)] if mode == "letter" else [seeded(f"{seed}-{bench}", id_col), F.col(pos)]
    return first_n(df, limit, *order) if limit else df.orderBy(*order)


def shard(df: DataFrame, index: int, count: int, pos: str = "place") -> DataFrame:
    return df.where(F.pmod(F.col(pos), F.lit(count)) == index)


def chunk(pos: str, size: int) -> Column:
    return F.floor(F.col(pos) / size)


def batch_seed(seed: int, start: Column, sample: Column) -> Column:
    return F.lit(seed) * 1_000_003 + start + sample * 100_003


def split_pool(candidates: DataFrame, held_dev: dict[str, int], held_pool: dict[str, int], near) -> tuple[DataFrame, DataFrame]:
    """(dev, pool): by source, the first rows of the clean and first-seen ones are dev, the next that aren't near any dev row the pool.

    candidates: source, pos (unique), key, all clean. near(rows, dev): ids (pos) of rows near dev.
    """
    from millrace.operators.decontam import first_of_key

    unique = first_of_key(candidates, "key", "pos").withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("pos")))
    quota = lambda q: F.coalesce(*(F.when(F.col("source") == s, F.lit(n)) for s, n in q.items()), F.lit(0))
    dev = unique.where(F.col("_n") <= quota(held_dev)).drop("_n")
    rest = unique.where(F.col("_n") > quota(held_dev)).drop("_n")
    rest = rest.join(near(rest, dev), "pos", "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("pos")))
    return dev, rest.where(F.col("_n") <= quota(held_pool)).drop("_n")


def merge_sets(*sets: DataFrame, seed: int = 0, id_col: str = "id") -> DataFrame:
    """All rows of several sets, with the set's number, in a seeded order."""
    out = None
    for no, s in enumerate(sets):
        s = s.withColumn("set_no", F.lit(no))
        out = s if out is None else out.unionByName(s)
    return out.orderBy(seeded(seed, id_col, "set_no"))
