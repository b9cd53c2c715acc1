"""Queries that go through files: predictions, ledgers, fingerprints and reports written and read back."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.plans.evaluation import PRED, firsts, predictions
from millrace.sources import io

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, or a temporary one in a session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{root.rstrip('/')}/millrace/{tag}-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("predictions_from_files", f"with {PRED} select model, mode, bench, count(*) as rows, count(letter) as letters, cast(sum(think_tokens) as bigint) as think from pred group by all")
def predictions_from_files(spark, sf):
    root, rows = scratch(spark, "predictions"), predictions(spark, sf).drop("event_id").persist()
    for model in ("m0", "m1", "m2"):
        for bench in ("medqa", "medmcqa"):
            part = rows.where((F.col("model") == model) & (F.col("bench") == bench)).drop("model", "mode", "bench")
            io.write_one_jsonl(part, f"{root}/{model}/reasoning__{bench}.jsonl", "id", "sample")
    rows.unpersist()
    got = io.check_one_file(io.read_predictions(spark, root))
    return got.groupBy("model", "mode", "bench").agg(F.count("*").alias("rows"), F.count("letter").alias("letters"), F.sum("think_tokens").alias("think"))


@query("ledger_csv", f"with {PRED} select model, count(*) as n, cast('' as varchar) as validation_loss from firsts group by model")
def ledger_csv(spark, sf):
    path = scratch(spark, "ledger")
    io.write_csv(firsts(spark, sf).groupBy("model").agg(F.count("*").alias("n")), path, ["model", "n", "validation_loss"])
    back = spark.read.schema("model string, n long, validation_loss string").option("header", "true").option("nullValue", "-").option("emptyValue", "").csv(path)
    return back.withColumn("validation_loss", F.coalesce("validation_loss", F.lit("")))


@query("jsonl_ordered", "select count(*) as rows, count(*) filter (text is null) as nulls from benchmark")
def jsonl_ordered(spark, sf):
    path = scratch(spark, "jsonl")
    io.write_jsonl(spark.read.parquet(f"{sf}/benchmark.parquet"), path, "item_id")
    return spark.read.schema("item_id long, text string").json(path).agg(F.count("*").alias("rows"), F.count_if(F.col("text").isNull()).alias("nulls"))


@query("first_form_predictions", "select * from (values ('q1', 'A', 'base', 'A'), ('q1', 'A', 'tuned', 'B'), ('q2', 'C', 'base', null), ('q2', 'C', 'tuned', 'C')) t(id, gold, model, letter)")
def first_form_predictions(spark, sf):
    path = scratch(spark, "first-form")
    rows = {"predictions": [{"id": "q1", "answer": "A", "constrained": {"base": "A", "tuned": "B"}}, {"id": "q2", "answer": "C", "constrained": {"base": None, "tuned": "C"}}]}
    spark.createDataFrame([(json.dumps(rows),)], "value string").coalesce(1).write.text(path)
    return io.read_first_form(spark, path)


@query("worker_meta", "select * from (values ('reasoning:weak', 120, 900.5::double)) t(stage, scored, seconds)")
def worker_meta(spark, sf):
    path = scratch(spark, "meta")
    meta = {"seed": 1, "stages": {"reasoning:weak": {"scored": 120, "seconds": 900.5}}}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(path)
    return io.read_meta(spark, path).select(F.explode("stages").alias("stage", "s")).select("stage", F.col("s.scored").cast("int").alias("scored"), "s.seconds")


@query("fingerprint", "select true as same, true as differs")
def fingerprint(spark, sf):
    """The digest of files is repeatable and depends on their order."""
    a, b = f"{sf}/region.parquet", f"{sf}/nation.parquet"
    one, again, other = io.fingerprint(spark, [a, b]), io.fingerprint(spark, [a, b]), io.fingerprint(spark, [b, a])
    return spark.createDataFrame([(one == again, one != other)], "same boolean, differs boolean")


@query("report_tables", f"with {PRED} select count(distinct model) as models, true as has_header from firsts")
def report_tables(spark, sf):
    rows = firsts(spark, sf).groupBy("model").agg(F.avg(F.col("correct").cast("double")).alias("accuracy")).orderBy("model")
    table, text = io.markdown_table(rows), io.report_json(rows)
    return spark.createDataFrame([(len(json.loads(text)), table.startswith("| model | accuracy |") and io.console_table(rows).startswith("model"))], "models long, has_header boolean")
