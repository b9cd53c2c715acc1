"""Verified traces: rejection reasons, choice of samples, direct rows, weak questions, teachers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.letters import ANSWER_LINE
from millrace.functions.text import strip, thinking_and_final
from millrace.operators.split import seeded


def reject_reason(max_think: int) -> Column:
    """The first thing wrong with a completion (closed, forced, letter, gold, text, think_tokens); null: nothing."""
    thinking, _ = thinking_and_final(F.col("text"))
    nested = F.coalesce(thinking, F.lit("")).eqNullSafe("") | thinking.contains("<think>") | thinking.contains("</think>")
    return (
        F.when(~F.coalesce("closed", F.lit(False)) | F.coalesce("forced", F.lit(False)), "unfinished_or_forced").when(~F.col("letter").eqNullSafe(F.col("gold")), "wrong_letter")
        .when(nested, "nested_think").when(F.coalesce("think_tokens", F.lit(0)) > max_think, "thinking_too_long")
    )


def judged(rows: DataFrame, max_think: int) -> DataFrame:
    return rows.withColumn("reason", reject_reason(max_think))


def pass_histogram(rows: DataFrame) -> DataFrame:
    """How many questions have kept/total samples."""
    per = rows.groupBy("id").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count("*").alias("total"))
    return per.groupBy(F.concat_ws("/", "kept", "total").alias("passed")).agg(F.count("*").alias("questions"))


def pick_samples(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """Up to most kept samples a question, by a seeded draw."""
    w = Window.partitionBy("id").orderBy(seeded(seed, "id", "sample"), "sample")
    return rows.where(F.col("reason").isNull()).withColumn("pick", F.row_number().over(w) - 1).where(F.col("pick") < most)


def trace_columns(text: Column) -> dict[str, Column]:
    """reasoning and rationale of a kept completion; its leading answer line goes, once."""
    thinking, final = thinking_and_final(text)
    return {"reasoning": thinking, "rationale": F.nullif(strip(F.regexp_replace(final, rf"(?s)^(.*?){ANSWER_LINE}", "$1")), F.lit(""))}


def direct_share(fitting: DataFrame, answered: DataFrame, fraction: float, seed: int, id_col: str = "id") -> DataFrame:
    """A seeded draw of answered questions that makes them `fraction` of the set with the fitting ones; none fit, none drawn."""
    n = fitting.agg(F.bround(F.count("*") * fraction / (1 - fraction)).cast("int").alias("n")).first()["n"] if fraction < 1 else 0
    return answered.select(id_col).distinct().orderBy(seeded(seed, id_col), id_col).limit(n or 0)


def weak_questions(rows: DataFrame) -> DataFrame:
    """Questions all of whose samples are rejected."""
    return rows.groupBy("id").agg(F.bool_and(F.col("reason").isNotNull()).alias("weak"), F.count("*").alias("samples")).where("weak").drop("weak")


def pilot_stats(rows: DataFrame, seconds: DataFrame) -> DataFrame:
    """Per teacher: questions answered and rescued, the rate, and rescued an hour."""
    got = rows.groupBy("teacher").agg(F.countDistinct("id").alias("answered"), F.countDistinct(F.when(F.col("reason").isNull(), F.col("id"))).alias("rescued"))
    return got.join(seconds, "teacher").withColumns({"rescue_rate": F.col("rescued") / F.col("answered"), "rescued_per_hour": F.when(F.col("seconds") > 0, F.col("rescued") / F.col("seconds") * 3600).otherwise(0.0)})


def choose_teacher(stats: DataFrame, floor: float = 0.2) -> DataFrame:
    """The able teacher with most rescues an hour, ties to the higher rate; null without one."""
    return stats.where((F.col("answered") > 0) & (F.col("rescue_rate") >= floor)).agg(F.max_by("teacher", F.struct("rescued_per_hour", "rescue_rate")).alias("teacher"))
