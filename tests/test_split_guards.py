"""Orders, shards, guards and the stream."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import guards, split
from millrace.sources import io
from millrace.streaming.dedupe import dedupe_stream


def test_places_and_shards(spark):
    for parts in (1, 7):
        df = split.place(spark.range(0, 1000, 1, parts).withColumn("v", 1000 - F.col("id")), "v")
        rows = df.collect()
        assert sorted(r.place for r in rows) == list(range(1000)) and all(r.place == r.v - 1 for r in rows)
        assert sum(split.shard(df, k, 3).count() for k in range(3)) == 1000


def test_a_shorter_stage_is_a_prefix(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), F.col("id").alias("pos"))
    order = lambda n: [r.id for r in split.stage_order(df, "reasoning", "medqa", 5, n).collect()]
    assert order(10) == order(30)[:10] == order(0)[:10] and len(order(0)) == 100 and order(10) != [str(k) for k in range(10)]


def test_train_val(spark):
    got = split.train_val(spark.range(50), 12, split.seeded(1, "id"), "id")
    assert got.where("split = 'val'").count() == 12 and got.count() == 50


def test_guards(spark):
    df = spark.createDataFrame([("a", "mcq", "A"), ("b", "mcq", "E")], "source string, kind string, answer string")
    with pytest.raises(guards.GuardError):
        guards.scorable(df)
    assert guards.scorable(df, "ABCDE").count() == 2
    guards.check_sizes(df, "source", {"a": 1, "b": 1})
    with pytest.raises(guards.GuardError):
        guards.check_sizes(df, "source", {"a": 2, "b": 1})
    with pytest.raises(guards.GuardError):
        guards.check_least(df, 3)
    with pytest.raises(guards.GuardError):
        guards.check_aligned(df, df.limit(1))
    with pytest.raises(guards.GuardError):
        guards.check_complete(df, df.limit(0), ["source"])
    assert io.parse_models(["a=x,y", "b=z"]) == {"a": ["x", "y"], "b": ["z"]}
    for bad in (["a"], ["=x"], ["a=x", "a=y"], ["a="]):
        with pytest.raises(guards.GuardError):
            io.parse_models(bad)


def test_missing_predictions_are_no_rows(spark, tmp_path):
    assert io.read_predictions(spark, f"file://{tmp_path}/none").count() == 0


def test_stream_keeps_first_rows(spark, tmp_path):
    spark.createDataFrame([("One two!",), ("one TWO",), ("three",)], "text string").coalesce(1).write.json(f"file://{tmp_path}/in")
    q = dedupe_stream(spark.readStream.schema("text string").json(f"file://{tmp_path}/in"), "text").writeStream.format("memory").queryName("deduped").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.key for r in spark.table("deduped").collect()) == ["one two", "three"]
