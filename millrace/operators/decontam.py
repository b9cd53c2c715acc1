"""Exact and n-gram benchmark hits, first-wins deduplication, and the shared index of held-out items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.grams import word_grams
from millrace.functions.text import question_key

GRAM, SHARE, MOST_BROADCAST, MOST_BYTES = 13, 0.5, 2_000_000, 256 << 20


class HeldOut:
    """Held-out items as keys and grams. Both are broadcast while grams and keys number MOST_BROADCAST each at most and the keys MOST_BYTES, else shuffled."""

    def __init__(self, items: DataFrame, text: str, gram: int = GRAM, share: float = SHARE):
        keyed = items.select(question_key(F.col(text)).alias("key"))
        self.gram, self.share = gram, share
        self.keys = keyed.distinct()
        lists = keyed.withColumn("item", F.xxhash64("key")).dropDuplicates(["item"]).withColumn("grams", word_grams(F.col("key"), gram)).where(F.size("grams") > 0)
        self.grams = lists.select("item", F.size("grams").alias("size"), F.explode("grams").alias("gram")).persist()
        size = self.keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("bytes")).first()
        self.small = size.n <= MOST_BROADCAST and size.bytes <= MOST_BYTES and self.grams.count() <= MOST_BROADCAST

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def verdicts(self, docs: DataFrame, id_col: str, key: str = "key") -> DataFrame:
        """id and verdict ('exact' or 'ngram') of contaminated rows; docs has unique ids and a key column.

        A row is an n-gram hit if it holds share of some item's distinct grams.
        """
        exact = docs.join(self._side(self.keys), docs[key] == self.keys["key"], "left_semi").select(id_col, F.lit("exact").alias("verdict"))
        grams = docs.select(id_col, word_grams(F.col(key), self.gram).alias("grams")).select(id_col, F.explode("grams").alias("gram"))
        counted = grams.join(self._side(self.grams), "gram").groupBy(id_col, "item", "size").agg(F.count("*").alias("n"))
        near = counted.where(F.col("n") >= self.share * F.col("size")).select(id_col, F.lit("ngram").alias("verdict"))
        return exact.unionByName(near).groupBy(id_col).agg(F.min("verdict").alias("verdict"))


def first_of_key(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each key in the order of pos; one partial minimum for each key, then a join on (key, pos).

    Keys may be whole texts, so both go by a digest of 128 bits. Rows without a key are left out.
    """
    named = df.withColumn("_digest", F.md5(F.col(key).cast("binary")))
    first = named.groupBy("_digest").agg(F.min(pos).alias(pos))
    return named.join(first, ["_digest", pos], "left_semi").select(*df.columns)


def without_held_out(df: DataFrame, items: DataFrame, key: str, item_key: str, pos: str) -> DataFrame:
    """The simple form: rows whose key is no held-out key, first of each key."""
    held = items.select(F.col(item_key).alias(key)).distinct()
    return first_of_key(df.join(held, key, "left_anti"), key, pos)
