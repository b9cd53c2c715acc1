"""Letters and explanations in plain Python, and Column functions on few rows."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import letters, text, traces


@pytest.mark.parametrize("said, letter", [("Therefore the best choice is (A).", "A"), ("the correct option would be: B", "B"), ("D is the best option", "D"), ("B is not the answer", None), ("The answer isn't clear", None), ("Answer: c", "C"), ("We choose A, then select D", "D"), ("C.", "C"), ("Hepatitis B is common", None)])
def test_find_letter(said, letter):
    assert letters.find_letter(said) == letter


def test_sentences_keep_abbreviations():
    assert letters.sentences("Dr. Who vs. Them. It ended. e.g. This one") == ["Dr. Who vs. Them.", "It ended. e.g. This one"]


def test_columns(spark):
    row = spark.createDataFrame([("wait, actually this. Therefore aspirin", "x\n" * 2 + "a long line that is repeated thrice\n" * 3)], "a string, b string").select(
        traces.conclusion(F.col("a")).alias("c"), traces.looping(F.col("b")).alias("l"), traces.looping(F.col("a")).alias("n"), traces.unterminated(F.col("a")).alias("u"),
        text.is_english(F.lit("")).alias("e"), text.is_english(F.lit("aaaé")).alias("f"), text.looks_medical(F.lit("A TUMOR")).alias("m"), text.opening_think(F.lit("<think> a </think> b")).alias("t"), traces.stems(F.lit("the heparins and Aspirin")).alias("s"),
    ).first()
    assert (row.c, row.l, row.n, row.u, row.e, row.f, row.m, row.t, sorted(row.s)) == ("Therefore aspirin", True, False, True, False, False, True, "a", ["aspir", "hepar"])
