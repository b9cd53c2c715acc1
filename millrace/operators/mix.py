"""Quota-driven mixing: greedy filling of entries as windows, length statistics and the length cap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REASONS = ("unusable", "other_kind", "exact", "ngram", "duplicate", "too_long", "kept")


@dataclass(frozen=True)
class Entry:
    """A source, the kind wanted from it, and how many rows."""

    name: str
    kind: str
    target: int

    @property
    def label(self) -> str:
        return f"{self.name}:{self.kind}"


def fill(rows: DataFrame, entries: list[Entry], max_len: int, factor: int = 8, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(rows seen, with entry_no and reason; kept rows) of filling entries in order, one after the other.

    rows: name, pos (unique and dense within a name), kind, key, usable, verdict ('exact', 'ngram' or
    null), length. An entry reads its first target * factor rows until its target is kept; the tests
    come in the order of REASONS. A key seen as duplicate, too long or kept blocks later rows, in this
    entry and the next ones; rows behind the stop block nothing. So entries are a loop, and within
    one the stop is a running count over at most target * factor rows.
    """
    seen_all = registered = None
    for no, e in enumerate(entries):
        target = max(1, round(e.target * scale))
        cand = rows.where((F.col("name") == e.name) & (F.col("pos") < target * factor))
        fine = F.col("usable") & (F.col("kind") == e.kind) & F.col("verdict").isNull()
        first = F.min(F.when(fine, F.col("pos"))).over(Window.partitionBy("key"))
        if registered is None:
            cand = cand.withColumn("_known", F.lit(False))
        else:
            cand = cand.join(registered.withColumn("_known", F.lit(True)), "key", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
        reason = (
            F.when(~F.col("usable"), "unusable").when(F.col("kind") != e.kind, "other_kind").when(F.col("verdict").isNotNull(), F.col("verdict"))
            .when(F.col("_known") | (F.col("pos") != first), "duplicate").when(F.col("length") > max_len, "too_long").otherwise("kept")
        )
        kept_before = F.coalesce(F.sum((F.col("reason") == "kept").cast("int")).over(Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seen = cand.withColumn("reason", reason).withColumn("_before", kept_before).where(F.col("_before") < target).drop("_before", "_known").withColumn("entry_no", F.lit(no)).withColumn("entry", F.lit(e.label))
        seen = seen.persist()
        keys = seen.where(F.col("reason").isin("duplicate", "too_long", "kept")).select("key").distinct()
        registered = keys if registered is None else registered.unionByName(keys).distinct()
        seen_all = seen if seen_all is None else seen_all.unionByName(seen)
    return seen_all, seen_all.where("reason = 'kept'")


def funnel(seen: DataFrame) -> DataFrame:
    """Rows seen and the count of each reason, by entry."""
    return seen.groupBy("entry_no", "entry").agg(F.count("*").alias("seen"), *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS))


def nearest_rank(column: str, share: float) -> Column:
    """The value at rank ceil(share * n) of a column of whole numbers."""
    return F.expr(f"cast(percentile_disc({share}) within group (order by {column}) as bigint)")


def length_stats(column: str, shares: dict[str, float] | None = None) -> list[Column]:
    shares = shares or {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    c = F.col(column)
    return [F.count(c).alias("n"), F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max"), *(nearest_rank(column, q).alias(name) for name, q in shares.items())]


def sequence_cap(column: str, cap: int, step: int = 64) -> Column:
    """The 99th percentile, up to the next multiple of step, cap at most."""
    return F.least(F.lit(cap), (F.ceil(nearest_rank(column, 0.99) / step) * step).cast("int"))


def sequence_cap_of_longest(column: str, least: int = 256, step: int = 64) -> Column:
    return F.greatest(F.lit(least), (F.ceil(F.max(column) / step) * step).cast("int"))


def within(df: DataFrame, column: str, cap: DataFrame) -> DataFrame:
    """Rows no longer than the one-row cap: dropped, never cut."""
    limit = cap.toDF("_cap")
    return df.join(F.broadcast(limit), F.col(column) <= F.col("_cap")).drop("_cap")


def shares(df: DataFrame, by: str, **flags: Column) -> DataFrame:
    """Rows, share of all rows, and the share for which each flag holds, by a column."""
    n = F.count("*")
    out = df.groupBy(by).agg(n.alias("rows"), *(F.avg(c.cast("double")).alias(k) for k, c in flags.items()))
    return out.withColumn("fraction", F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(0))))
