"""Token arrays, letter scores, deadlines and the parsers of a worker's arguments."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import tokens
from millrace.operators import guards, plan


def test_token_rows(spark):
    rows = [([1, 9, 2, 9, 7, 5, 5],), ([1, 2],), ([5, 5],), ([],), ([1, 9],)]
    df = spark.createDataFrame(rows, "w array<int>")
    said = lambda c: F.when(F.array_contains(c, 7), F.lit("Answer: B")).otherwise(F.lit(""))
    cols = tokens.row_of_tokens(F.col("w"), 9, [5], said, F.array(F.lit("A"), F.lit("B")))
    got = [tuple(r) for r in df.select(*(cols[k].alias(k) for k in ("closed", "new_tokens", "think_tokens", "letter", "forced")), tokens.hit_the_cap(F.col("w"), [5]).alias("cap")).collect()]
    assert got == [(True, 5, 3, "B", False, False), (False, 2, 2, None, True, True), (False, 0, 0, None, True, False), (False, 0, 0, None, True, True), (True, 2, 1, None, True, True)]
    assert tokens.stop_ids(None, None) == [] and tokens.stop_ids(3, 3) == [3] and tokens.stop_ids([2, 1], 3) == [1, 2, 3]


def test_pick_letter(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([-1.0, -2.0, -3.0],)], "s array<double>")
    pick = tokens.pick_letter(F.col("s"), F.array(*map(F.lit, "ABC")))
    assert [r[0] for r in df.select(pick).collect()] == ["B", "A"]
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="not finite"):
            spark.createDataFrame([([1.0, bad, 0.0],)], "s array<double>").select(pick).collect()


def test_before_deadline(spark):
    took = {"a": [10.0, 50.0, 1.0, 1.0], "b": [200.0], "c": [1.0]}
    df = spark.createDataFrame([(k, i, t) for k, v in took.items() for i, t in enumerate(v)], "stage string, i int, took double")
    got = {r.stage: (r.done, r.used) for r in plan.before_deadline(df, ["stage"], "i", "took", 75, 20).collect()}
    assert got == {"a": (2, 60.0), "b": (1, 200.0), "c": (1, 1.0)}  # after 10 and 50 the rate is 18: 60 + 18 > 75
    assert {r.done for r in plan.before_deadline(df, ["stage"], "i", "took", 15, 20).collect()} == {0}


def test_parsers():
    known = [("letter", "medqa"), ("reasoning", "medqa")]
    assert guards.parse_stages("", known[:1], known) == known[:1] and guards.parse_stages(" reasoning:medqa", [], known) == known[1:]
    assert guards.parse_counts("medqa=2, ,", {"medqa"}, 1) == {"medqa": 2} and guards.parse_counts(None, set(), 0) == {}
    assert guards.check_role("base", "x") is None and guards.check_role("tuned", "x") == "x" and guards.check_role("teacher", None, plain=True) is None
    for bad in (lambda: guards.parse_stages("letter:x", [], known), lambda: guards.parse_counts("medqa=0", {"medqa"}, 1), lambda: guards.check_role("Tuned", "x"), lambda: guards.check_role("tuned", None), lambda: guards.check_role("t", "x", plain=True)):
        with pytest.raises(guards.GuardError):
            bad()
