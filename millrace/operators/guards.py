"""Checks that stop a run: each is one small aggregate."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A table isn't what the next step needs."""


def size_report(df: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """by, expected, found, ok of every group that is expected or found."""
    found = df.groupBy(by).agg(F.count("*").alias("found"))
    both = expected.join(found, by, "full").select(by, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.withColumn("ok", F.col("expected") == F.col("found"))


def check_sizes(df: DataFrame, by: str, expected: dict[str, int]) -> None:
    spark = df.sparkSession
    wrong = size_report(df, by, spark.createDataFrame(list(expected.items()), f"{by} string, expected long")).where("not ok").limit(20).collect()
    if wrong:
        raise GuardError("wrong sizes: " + ", ".join(f"{r[0]}: {r['found']} instead of {r['expected']}" for r in wrong))


def scorable(records: DataFrame, letters: str = "ABCD") -> DataFrame:
    """Multiple-choice records; stops if one's answer is no letter."""
    mcq = records.where(F.col("kind") == "mcq")
    bad = mcq.where(~F.coalesce(F.col("answer").isin(list(letters)), F.lit(False))).limit(1).count()
    if bad:
        raise GuardError(f"an answer is not one of {letters}")
    return mcq


def check_aligned(*tables: DataFrame) -> None:
    counts = [t.count() for t in tables]
    if len(set(counts)) > 1:
        raise GuardError(f"tables differ in length: {counts}")


def check_complete(left: DataFrame, right: DataFrame, on: list[str]) -> None:
    """Stops if a left row has no partner."""
    if left.join(right, on, "left_anti").limit(1).count():
        raise GuardError(f"rows without a partner by {on}")


def check_least(df: DataFrame, least: int) -> DataFrame:
    n = df.limit(least).count()
    if n < least:
        raise GuardError(f"{n} rows, {least} needed")
    return df


def parse_stages(text: str, default: list[tuple[str, str]], known: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """'mode:benchmark,...' as pairs; empty: the default; stops at one that isn't known."""
    if not text:
        return list(default)
    found = [tuple(part.strip() for part in item.strip().partition(":")[::2]) for item in text.split(",")]
    if unknown := [s for s in found if s not in known]:
        raise GuardError(f"unknown stages: {unknown}")
    return found


def parse_counts(text: str | None, known: set[str], least: int) -> dict[str, int]:
    """'benchmark=n,...' as numbers, least at least; blank items are passed over."""
    out = {}
    for name, _, n in (item.strip().partition("=") for item in (text or "").split(",") if item.strip()):
        if name not in known or not n.isdigit() or int(n) < least:
            raise GuardError(f"bad count {name}={n}: a known benchmark and {least} or more")
        out[name] = int(n)
    return out


def check_role(role: str, adapter: str | None, plain: bool = False) -> str | None:
    """The adapter of a role: none for 'base' and plain models, needed for all others."""
    if not re.fullmatch(r"[a-z0-9_]+", role):
        raise GuardError(f"role {role!r}: lower-case letters, digits and _ only")
    if plain and adapter:
        raise GuardError(f"role {role} is plain and has an adapter")
    if role == "base" or plain:
        return None
    if not adapter:
        raise GuardError(f"role {role} needs an adapter")
    return adapter
