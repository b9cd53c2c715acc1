"""First-wins deduplication of a stream of texts: the batch operator's key, kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import question_key


def dedupe_stream(stream: DataFrame, text: str, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose key wasn't seen before; with an event time, keys are forgotten after the delay."""
    keyed = stream.withColumn("key", question_key(F.col(text)))
    if event_time is None:
        return keyed.dropDuplicates(["key"])
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["key"])
