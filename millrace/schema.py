"""Row types: the record (one example), predictions, and what reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()

RECORD = T.StructType(
    [T.StructField(n, _S) for n in ("id", "source", "kind", "question")]
    + [T.StructField("options", T.MapType(_S, _S))]
    + [T.StructField(n, _S) for n in ("answer", "rationale", "response", "subject", "reasoning")]
)
LETTER_ROW = T.StructType([T.StructField("id", _S), T.StructField("letter", _S)])
PREDICTION = T.StructType(
    [T.StructField("id", _S), T.StructField("letter", _S), T.StructField("closed", T.BooleanType()), T.StructField("forced", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in ("new_tokens", "think_tokens", "seed")]
    + [T.StructField("text", _S), T.StructField("sample", T.LongType())]
)
WORKER_META = T.StructType([T.StructField("seed", T.LongType()), T.StructField("limit", T.LongType()), T.StructField("stages", T.MapType(_S, T.StructType([T.StructField("scored", T.LongType()), T.StructField("planned", T.LongType()), T.StructField("seconds", T.DoubleType())])))])

#: The order of stages, as (mode, benchmark).
STAGES = [(mode, bench) for mode in ("letter", "reasoning") for bench in ("medqa", "medmcqa", "pubmedqa", "mmlu_medical")]


def as_records(df: DataFrame) -> DataFrame:
    """Missing record columns become null; others are dropped."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD))


def record_json(prefix: str = "") -> Column:
    """A record as one JSON object, nulls written out."""
    return F.to_json(F.struct(*(F.col(prefix + f.name) for f in RECORD)), {"ignoreNullFields": "false"})


def from_record_json(c: Column) -> Column:
    return F.from_json(c, RECORD)
