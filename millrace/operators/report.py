"""Model comparison over prediction tables.

Predictions: model, mode, bench, id, sample, letter, and counts; benchmarks: bench, id, gold,
subject, pos. One pass serves all models and stages; nothing loops over files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.mix import nearest_rank
from millrace.operators.stats import accuracy, is_right, paired_report

STAGE = ["mode", "bench"]
QUESTION = ["model", "mode", "bench", "id"]


def first_samples(predictions: DataFrame, line: str | None = None) -> DataFrame:
    """Sample 0 (a missing number is 0) of each question; of several, the last line of the file."""
    zero = predictions.where(F.coalesce("sample", F.lit(0)) == 0)
    order = F.col(line) if line else F.monotonically_increasing_id()
    rest = [c for c in predictions.columns if c not in QUESTION]
    return zero.withColumn("_line", order).groupBy(*QUESTION).agg(F.max_by(F.struct(*rest), "_line").alias("_r")).select(*QUESTION, "_r.*")


def samples_of(predictions: DataFrame) -> DataFrame:
    """All samples of a question, in their order, as one array; n_samples."""
    got = predictions.groupBy(*QUESTION).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("sample", F.lit(0)).alias("sample"), "letter"))).alias("samples"))
    return got.withColumn("n_samples", F.size("samples"))


def majority_letter(letters: Column) -> Column:
    """The most frequent letter of an array, ties to the first to appear; nulls don't vote."""
    votes = F.filter(letters, lambda x: x.isNotNull())
    distinct = F.array_distinct(votes)
    scored = F.transform(distinct, lambda d, i: F.struct(F.size(F.filter(votes, lambda v: v == d)).alias("n"), (-i).alias("o"), d.alias("letter")))
    return F.array_max(scored)["letter"]


def scored(predictions: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Predictions with gold, subject and correct."""
    return predictions.join(benchmarks, ["bench", "id"]).withColumn("correct", is_right("letter", "gold"))


def model_summary(firsts: DataFrame) -> DataFrame:
    """One row a model and stage, from scored first samples."""
    return firsts.groupBy("model", *STAGE).agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count_if(F.col("letter").isNull()).alias("unparseable"),
        F.count_if("forced").alias("forced"), F.count_if("closed").alias("closed"), nearest_rank("new_tokens", 0.5).alias("median_new_tokens"),
        nearest_rank("think_tokens", 0.5).alias("median_think"), F.avg("think_tokens").alias("mean_think"), nearest_rank("think_tokens", 0.9).alias("p90_think"), nearest_rank("think_tokens", 0.95).alias("p95_think"),
    )


def any_correct(predictions: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Any, majority and first-sample accuracy over the first k samples, k the least number among questions with several."""
    multi = samples_of(predictions).where("n_samples > 1").join(benchmarks.select("bench", "id", "gold"), ["bench", "id"])
    least = multi.groupBy("model", *STAGE).agg(F.min("n_samples").alias("k"))
    cut = multi.join(F.broadcast(least), ["model", *STAGE]).withColumn("letters", F.transform(F.slice("samples", F.lit(1), F.col("k")), lambda s: s["letter"]))
    right = F.coalesce(F.array_contains(F.filter("letters", lambda x: x.isNotNull()), F.col("gold")), F.lit(False))
    cut = cut.withColumns({"_any": right, "_major": F.coalesce(majority_letter(F.col("letters")) == F.col("gold"), F.lit(False)), "_first": F.coalesce(F.get("letters", F.lit(0)) == F.col("gold"), F.lit(False))})
    return cut.groupBy("model", *STAGE, "k").agg(F.count("*").alias("n"), accuracy(F.col("_any")).alias("any_accuracy"), accuracy(F.col("_major")).alias("majority_accuracy"), accuracy(F.col("_first")).alias("first_accuracy"))


def common_questions(firsts: DataFrame) -> DataFrame:
    """Questions that every model of a stage answered: mode, bench, id."""
    models = firsts.groupBy(*STAGE).agg(F.countDistinct("model").alias("_all"))
    per = firsts.groupBy(*STAGE, "id").agg(F.countDistinct("model").alias("_n"))
    return per.join(F.broadcast(models), STAGE).where("_n = _all").select(*STAGE, "id")


def common_accuracy(firsts: DataFrame) -> DataFrame:
    return firsts.join(common_questions(firsts), [*STAGE, "id"], "left_semi").groupBy("model", *STAGE).agg(F.count("*").alias("n"), accuracy(F.col("correct")).alias("accuracy"))


def against(firsts: DataFrame, baseline: str, by: list[str] | None = None) -> DataFrame:
    """Every other model paired with the baseline on the questions both answered."""
    base = firsts.where(F.col("model") == baseline).select(*STAGE, "id", F.col("letter").alias("base_letter"))
    pairs = firsts.where(F.col("model") != baseline).withColumnRenamed("letter", "other_letter").join(base, [*STAGE, "id"])
    return paired_report(pairs, by or ["model", *STAGE])


def pooled(firsts: DataFrame) -> DataFrame:
    """n and accuracy by stage and, bench null, by mode over all its benches."""
    grouped = firsts.groupingSets([[F.col("model"), F.col("mode"), F.col("bench")], [F.col("model"), F.col("mode")]], F.col("model"), F.col("mode"), F.col("bench"))
    return grouped.agg(F.count("*").alias("n"), accuracy(F.col("correct")).alias("accuracy"))


def reasoning_counts(firsts: DataFrame) -> DataFrame:
    """forced, closed and the interpolated median of new tokens."""
    return firsts.groupBy("model", *STAGE).agg(F.count_if("forced").alias("forced"), F.count_if("closed").alias("closed"), F.median("new_tokens").alias("median_new_tokens"))


def export_rows(predictions: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """One row a model, question and sample."""
    return scored(predictions, benchmarks).select(
        F.col("id").alias("question_id"), "bench", "mode", "model", F.coalesce("sample", F.lit(0)).alias("sample"), F.col("gold").alias("gold_answer"), F.col("letter").alias("prediction"),
        "correct", F.col("think_tokens").alias("thinking_length"), "new_tokens", "forced", "closed", "subject",
    )


def ledger(firsts: DataFrame, stages: list[str]) -> DataFrame:
    """A row for each model, a column for each 'mode:bench': accuracy on the questions all models answered."""
    acc = common_accuracy(firsts).withColumn("stage", F.concat_ws(":", "mode", "bench"))
    return acc.groupBy("model").pivot("stage", stages).agg(F.first("accuracy"))


def thinking_length(firsts: DataFrame) -> DataFrame:
    """Median think_tokens where every row has them, else median new_tokens, and which it is."""
    every = F.count("think_tokens") == F.count("*")
    return firsts.groupBy("model", *STAGE).agg(F.when(every, nearest_rank("think_tokens", 0.5)).otherwise(nearest_rank("coalesce(new_tokens, 0)", 0.5)).alias("median_length"), F.when(every, "think_tokens").otherwise("new_tokens").alias("kind"))
