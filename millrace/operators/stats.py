"""Paired statistics: accuracy, contingency, exact McNemar, paired interval, by subject."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.959964  # two-sided 95 %


def is_right(letter: str, gold: str) -> Column:
    """A letter that can't be read is wrong, not left out."""
    return F.coalesce(F.col(letter) == F.col(gold), F.lit(False))


def accuracy(right: Column) -> Column:
    return F.coalesce(F.avg(right.cast("double")), F.lit(0.0))


def contingency(base: Column, other: Column) -> list[Column]:
    """n, both right, wins (only the other), regressions (only the base), both wrong."""
    return [F.count("*").alias("n"), F.count_if(base & other).alias("both"), F.count_if(~base & other).alias("wins"), F.count_if(base & ~other).alias("regressions"), F.count_if(~base & ~other).alias("neither")]


def mcnemar(wins: Column, regressions: Column) -> Column:
    """Two-sided exact p: twice the lower binomial tail at one half, 1 at most.

    Terms follow by a recurrence of logarithms, ln C(n,i+1) = ln C(n,i) + ln((n-i)/(i+1)), as 2^n overflows.
    """
    n = wins + regressions
    start = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("s"))

    def add(a: Column, i: Column) -> Column:
        term = F.exp(a["l"] - n * math.log(2))
        return F.struct((a["l"] + F.log((n - i) / (i + 1.0))).alias("l"), (a["s"] + term).alias("s"))

    # the step to i = n would take the logarithm of 0; the tail stops at n / 2 before it, but for n = 0
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(wins, regressions)), start, add, lambda a: a["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired_interval(n: Column, wins: Column, regressions: Column) -> dict[str, Column]:
    """The change in accuracy with its Wald interval for paired answers, inside -1..1."""
    diff = (wins - regressions) / n
    half = Z * F.sqrt(F.greatest(F.lit(0.0), (wins + regressions) - F.pow(wins - regressions, F.lit(2)) / n)) / n
    return {"diff": diff, "ci_low": F.greatest(F.lit(-1.0), diff - half), "ci_high": F.least(F.lit(1.0), diff + half)}


def paired_report(pairs: DataFrame, by: list[str], base: str = "base_letter", other: str = "other_letter", gold: str = "gold") -> DataFrame:
    """One row a group: the cells, accuracies, unreadable answers, p and interval."""
    b, o = is_right(base, gold), is_right(other, gold)
    cells = pairs.groupBy(*by).agg(*contingency(b, o), accuracy(b).alias("base_accuracy"), accuracy(o).alias("other_accuracy"), F.count_if(F.col(base).isNull()).alias("base_unparseable"), F.count_if(F.col(other).isNull()).alias("other_unparseable"))
    return cells.withColumn("p_value", mcnemar(F.col("wins"), F.col("regressions"))).withColumns(paired_interval(F.col("n"), F.col("wins"), F.col("regressions")))


def by_subject(pairs: DataFrame, subject: str, base: Column, other: Column, pos: str) -> DataFrame:
    """Rows and accuracies of each subject (null or empty: unknown), largest first, ties in order of appearance."""
    name = F.coalesce(F.nullif(F.col(subject), F.lit("")), F.lit("unknown"))
    got = pairs.groupBy(name.alias("subject")).agg(F.count("*").alias("n"), accuracy(base).alias("base_accuracy"), accuracy(other).alias("other_accuracy"), F.min(pos).alias("_first"))
    return got.orderBy(F.col("n").desc(), "_first").drop("_first")
