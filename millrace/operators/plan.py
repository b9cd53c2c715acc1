"""Estimates of run time from measured rates: joins of small configuration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage_seconds(rate: Column, n: Column, samples: Column, slowdown: Column) -> Column:
    return rate * n * F.coalesce(samples, F.lit(1)) * F.coalesce(slowdown, F.lit(1.0))


def queue_hours(stages: DataFrame, rates: DataFrame) -> DataFrame:
    """Hours of each queue; stages: queue, mode, bench, n, samples, slowdown; rates: mode, bench, seconds_each."""
    met = stages.join(F.broadcast(rates), ["mode", "bench"]).withColumn("seconds", stage_seconds(F.col("seconds_each"), F.col("n"), F.col("samples"), F.col("slowdown")))
    return met.groupBy("queue").agg(F.sum("seconds").alias("seconds"), (F.sum("seconds") / 3600).alias("hours"))


def projected(done: Column, seconds: Column, total: Column) -> Column:
    """Seconds for all of total at the pace so far."""
    return F.when(done > 0, seconds / done * total)


def over_budget(seconds: Column, budget: Column | int) -> Column:
    """Whether a projected time is known and beyond the budget."""
    return F.coalesce((seconds > 0) & (seconds > budget), F.lit(False))


def eval_seconds(n_constrained: Column, each_constrained: Column, n_generative: Column, each_generative: Column, models: int = 2) -> Column:
    """Whole seconds to score so many questions in both ways with some models."""
    return (models * (n_constrained * each_constrained + n_generative * each_generative)).cast("long")


def before_deadline(batches: DataFrame, by: list[str], pos: str, took: str, seconds: float, guess: float, weight: float = 0.2) -> DataFrame:
    """by, done, used: how many of a stage's batches run, in order, until one doesn't fit, and the seconds they take.

    A batch runs if the time left covers the moving rate: guess before the first batch, then the first
    one's time, then (1 - weight) * rate + weight * time. The rate depends on all batches before, so it
    is a fold over a stage's batches, as arrays of numbers.
    """
    start = F.struct(F.lit(0).cast("long").alias("done"), F.lit(0.0).alias("used"), F.lit(float(guess)).alias("rate"), F.lit(False).alias("over"))

    def step(a: Column, b: Column) -> Column:
        over = a["over"] | (a["used"] + a["rate"] > seconds)
        rate = F.when(a["done"] == 0, b["took"]).otherwise((1 - weight) * a["rate"] + weight * b["took"])
        return F.when(over, F.struct(a["done"].alias("done"), a["used"].alias("used"), a["rate"].alias("rate"), F.lit(True).alias("over"))).otherwise(
            F.struct((a["done"] + 1).alias("done"), (a["used"] + b["took"]).alias("used"), rate.alias("rate"), F.lit(False).alias("over"))
        )

    listed = batches.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(took).cast("double").alias("took")))).alias("_b"))
    return listed.withColumn("_s", F.aggregate("_b", start, step)).select(*by, F.col("_s.done").alias("done"), F.col("_s.used").alias("used"))


def loss_curve(log: DataFrame) -> DataFrame:
    """step, epoch, loss, lr of log entries that have a loss; log: array column 'history' of structs."""
    return log.select(F.explode("history").alias("h")).select("h.step", "h.epoch", "h.loss", F.col("h.learning_rate").alias("lr")).where("loss is not null")
