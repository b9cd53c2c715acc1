"""JSONL predictions and records in and out, discovery by file name, reports, sheets and fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.guards import GuardError
from millrace.operators.split import per_group, seeded
from millrace.schema import PREDICTION, RECORD, WORKER_META


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """All <mode>__<bench>.jsonl below root; model is the folder a file is in. A missing root gives no rows."""
    if not exists(spark, root):
        rows = spark.createDataFrame([], PREDICTION).withColumn("_file", F.lit(""))
    else:
        rows = spark.read.schema(PREDICTION).option("recursiveFileLookup", "true").option("pathGlobFilter", "*__*.jsonl").json(root).withColumn("_file", F.col("_metadata.file_path"))
    stage = F.regexp_extract("_file", r"([^/]+)\.jsonl$", 1)
    return rows.withColumns({"model": F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1), "mode": F.split_part(stage, F.lit("__"), F.lit(1)), "bench": F.split_part(stage, F.lit("__"), F.lit(2))})


def check_one_file(predictions: DataFrame) -> DataFrame:
    """Stops if a model has a stage in two files."""
    twice = predictions.groupBy("model", "mode", "bench").agg(F.countDistinct("_file").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise GuardError(f"{twice[0]['model']} has {twice[0]['mode']}:{twice[0]['bench']} in several files")
    return predictions


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORKER_META).option("multiLine", "true").json(path)


def read_first_form(spark: SparkSession, path: str) -> DataFrame:
    """The early evaluation file: id, gold, model, letter from nested predictions."""
    schema = "predictions array<struct<id:string,answer:string,constrained:struct<base:string,tuned:string>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("predictions").alias("p"))
    pairs = F.array(F.struct(F.lit("base").alias("model"), F.col("p.constrained.base").alias("letter")), F.struct(F.lit("tuned").alias("model"), F.col("p.constrained.tuned").alias("letter")))
    return rows.select(F.col("p.id").alias("id"), F.col("p.answer").alias("gold"), F.explode(pairs).alias("m")).select("id", "gold", "m.model", "m.letter")


def write_jsonl(df: DataFrame, path: str, *order: Column | str, one_file: bool = True) -> None:
    """One object a line, nulls written, in order; as one file or as ordered parts."""
    ordered = df.orderBy(*order) if order else df
    (ordered.coalesce(1) if one_file else ordered).write.option("ignoreNullFields", "false").json(path)


def write_one_jsonl(df: DataFrame, path: str, *order: Column | str) -> None:
    """One object a line in the one file at path."""
    write_jsonl(df, path + ".parts", *order)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(path + ".parts"), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    for part in fs.globStatus(jvm.org.apache.hadoop.fs.Path(path + ".parts/part-*")):
        fs.rename(part.getPath(), target)
    fs.delete(folder, True)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns, absent ones and nulls empty."""
    have = set(df.columns)
    df.select(*((F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in columns)).coalesce(1).write.option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def report_json(row: DataFrame, digits: int = 4) -> str:
    """A small result as JSON, doubles rounded here and only here."""

    def tidy(x):
        return round(x, digits) if isinstance(x, float) else {k: tidy(v) for k, v in x.items()} if isinstance(x, dict) else [tidy(v) for v in x] if isinstance(x, list) else x

    return json.dumps([tidy(r.asDict(recursive=True)) for r in row.collect()], indent=2, default=str)


def markdown_table(rows: DataFrame, digits: int = 3) -> str:
    got = rows.collect()
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in got)])


def console_table(rows: DataFrame, digits: int = 3) -> str:
    cells = [rows.columns, *([f"{v:.{digits}f}" if isinstance(v, float) else "-" if v is None else str(v) for v in r] for r in rows.collect())]
    width = [max(len(r[k]) for r in cells) for k in range(len(rows.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in cells)


def sample_sheet(df: DataFrame, by: str, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows of each group, drawn by a seeded hash."""
    return per_group(df, [by], n, seeded(seed, id_col), id_col)


def fingerprint(spark: SparkSession, paths: list[str], hex_digits: int = 16) -> str:
    """A short digest of files in the order given: of each name and its bytes' sha-256."""
    rows = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha"), "path").collect()
    order = {p.rstrip("/").rsplit("/", 1)[-1]: k for k, p in enumerate(paths)}
    whole = hashlib.sha256()
    for r in sorted(rows, key=lambda r: (order.get(r["name"], len(order)), r["path"])):
        whole.update(r["name"].encode() + b"\0" + r["sha"].encode() + b"\0")
    return whole.hexdigest()[:hex_digits]


def parse_models(specs: list[str]) -> dict[str, list[str]]:
    """'name=folder[,folder]' of each model; blank or double names stop."""
    out: dict[str, list[str]] = {}
    for spec in specs:
        name, eq, folders = spec.partition("=")
        paths = [f for f in folders.split(",") if f]
        if not eq or not name or not paths or name in out:
            raise GuardError(f"bad or double model: {spec!r}")
        out[name] = paths
    return out
