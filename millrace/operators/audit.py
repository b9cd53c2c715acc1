"""The audit of a record table: one wide aggregate over flag columns, by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.traces import ambiguous_options, answer_agreement, label_of, malformed, style_flags, suspected_bad, suspicious_flags
from millrace.operators.mix import length_stats

#: Labels whose gold letter comes from an exam, and those without one.
EXAM_GOLD, NO_GOLD = ("medqa", "medmcqa"), ("reasonmed",)
AGREEMENTS = ("n/a", "agree", "conflict", "agree_text", "other_text", "unstated")


def copies(key: str) -> Column:
    """How many rows of the whole table have this row's key."""
    return F.count("*").over(Window.partitionBy(key))


def duplicate_rows(df: DataFrame, key: str, by: str) -> DataFrame:
    """Rows whose key occurs more than once in the whole table, by label: counted by (label, key) first, so a hot key is one row a label."""
    per = df.groupBy(by, key).agg(F.count("*").alias("_n"))
    total = per.groupBy(key).agg(F.sum("_n").alias("_all"))
    return per.join(total, key).groupBy(by).agg(F.sum(F.when(F.col("_all") > 1, F.col("_n")).otherwise(0)).alias("duplicates"))


def flagged(records: DataFrame, words: Column | None = None) -> DataFrame:
    """Records with their flags, one column each."""
    r = [F.col(c) for c in ("kind", "question", "options", "answer", "response", "reasoning")]
    kind, _, options, answer, response, reasoning = r
    out = records.withColumn("label", label_of(F.col("source"), kind)).withColumn("has_trace", F.coalesce(reasoning, F.lit("")) != "")
    out = out.withColumns({"agreement": answer_agreement(kind, reasoning, options, answer), "malformed": malformed(*r), "bad": suspected_bad(*r), "ambiguous": ambiguous_options(options)})
    out = out.withColumns({f"s_{k}": v for k, v in suspicious_flags(reasoning, response, options).items()})
    out = out.withColumns({f"y_{k}": F.when(F.col("has_trace"), v) for k, v in style_flags(reasoning).items()})
    trace_words = F.regexp_count(F.coalesce(reasoning, F.lit("")), F.lit(r"\S+")) if words is None else words
    return out.withColumn("trace_words", F.when(F.col("has_trace"), trace_words))


def by_label(flags: DataFrame) -> DataFrame:
    """One row a label."""
    gold_in_options = F.coalesce(F.array_contains(F.map_keys("options"), F.col("answer")), F.lit(False))
    verified = F.when(F.col("label").isin(*NO_GOLD), F.lit(0)).when(F.count_if("has_trace") > 0, F.count_if(F.col("agreement").isin("agree", "agree_text"))).when(F.col("label").isin(*EXAM_GOLD), F.count_if((F.col("kind") == "mcq") & gold_in_options)).otherwise(F.lit(0))
    counts = [F.count_if(f"s_{k}").alias(k) for k in ("think_tags", "answer_given", "looping", "mid_sentence", "short_trace", "non_ascii", "as_an_ai", "two_answers")]
    styles = [F.avg(F.col(f"y_{k}").cast("double")).alias(k) for k in ("first_person_open", "markdown", "kg_template", "self_checks_per_1k_words")]
    return flags.groupBy("label").agg(
        F.count("*").alias("rows"), F.count_if("has_trace").alias("reasoning_rows"), F.count_if(F.col("kind") == "mcq").alias("mcq_rows"),
        *(F.count_if(F.col("agreement") == a).alias("agreement_" + a.replace("/", "")) for a in AGREEMENTS),
        verified.cast("long").alias("answer_verified"), F.count_if("bad").alias("suspected_bad"), F.count_if("ambiguous").alias("ambiguous_options"),
        F.count_if(F.size("malformed") > 0).alias("malformed_rows"), *counts, *styles, *(c.alias(f"words_{n}") for c, n in zip(length_stats("trace_words"), ("n", "min", "mean", "max", "median", "p90", "p95", "p99"))),
    )
