"""Operator 9, mixing sources to target weights, by DataFrame functions alone.

The words of a source, its documents in hash order, are a stream that is packed into blocks of
block_words words (the last may be shorter). A source's target is filled by whole passes over its
blocks and a part of one more. Each of these takings is a slot of the source, and the mix has as
many places, in shards of shard_slots places.

Every place of every shard draws a source by hash, with the sources' slots as weights: so the source
counts of a shard are a multinomial draw. The k-th draw of a source over all shards is its k-th slot.
The draws' totals miss the slots by chance, a root of their number: draws beyond a source's last
slot go, in order, to the sources that were drawn too seldom, so that each slot is used exactly once
and the words taken meet the targets. Within a source, the slots of each pass are mapped to blocks
by a pseudorandom permutation of that source and pass, and slots and blocks are joined by source
and block index.

Permutations are swap-or-not networks: exact on any number of items, with nothing stored. The
place of a document in its source's stream is the sum of the sizes before it: sums for each source
and hash bucket, and running sums inside a bucket, so that a source with a third of all rows is
spread; a draw's number is found alike, by ranges of shards. The same rows give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import MOST_BROADCAST, WORD, parts, table, written

BLOCK_WORDS, SHARD_SLOTS, MOST_USES, ROUNDS, CHUNK = 256, 1024, 3, 24, 4096


def shuffled(index: Column, n: Column, *keys: Column, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1, chosen by keys, at index. Each round is its own inverse."""

    def turn(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(F.lit("key"), *keys, r), n) - x, n)
        return F.when(F.xxhash64(F.lit("bit"), *keys, r, F.greatest(x, y)).bitwiseAND(F.lit(1)) == 1, y).otherwise(x)

    first, last = (ROUNDS - 1, 0) if inverse else (0, ROUNDS - 1)
    return F.aggregate(F.sequence(F.lit(first), F.lit(last)), index, turn)


def targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST_USES) -> DataFrame:
    """source, source_size, source_no, target of every source of a table with source and size.

    Sources by code point, null last, weigh `weights` in turn and share the size of all. A target
    stops at most times its source's size and the rest is shared again by weight; the level at
    which none is above follows from the sources in order of size for weight.
    """
    all_rows = Window.partitionBy(F.lit(0))  # sources, not documents
    by_name = all_rows.orderBy(F.col("source").isNull(), "source")
    by_room = all_rows.orderBy("_room", "source_no")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(by_name).cast("long") - 1)
    s = s.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int")))
    s = s.withColumn("_room", F.col("source_size") * most / F.col("_w"))
    s = s.withColumns({"_total": F.sum("source_size").over(all_rows), "_left_w": F.sum("_w").over(by_room.rowsBetween(0, Window.unboundedFollowing)), "_full": F.coalesce(F.sum(F.col("source_size") * most).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    s = s.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_left_w"))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_room"), F.struct("_room", "source_no", "_level"))).over(all_rows)["_level"])
    return s.select("source", "source_size", "source_no", F.least(F.col("source_size") * float(most), F.col("_level") * F.col("_w")).alias("target"))


def placed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, text_hash, source, size, source_size, source_no, target, offset of every row: a written table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sizes")
    buckets = 4 * parts(docs.sparkSession)
    sources = targets(sized, weights)
    rows = sized.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    tally = rows.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_n"))
    before = tally.select("source_no", "_bucket", (F.sum("_n").over(Window.partitionBy("source_no").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("source_no", "_bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before, ["source_no", "_bucket"]).withColumn("offset", F.col("_before") + F.sum("size").over(inside) - F.col("size"))
    return written(out.drop("_bucket", "_before"), "placed")


def draws(spark: SparkSession, sources: DataFrame, total: int, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, place, source_no, k: the source of each of total places, and which of the source's slots it takes.

    sources: source_no, first, slots, in ranges that cover 0..total-1.
    """
    shard_range = 1024
    places = spark.range(total).select(F.expr(f"id div {shard_slots}").alias("shard"), (F.col("id") % shard_slots).alias("place"), F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), "id"), F.lit(max(1, total))).alias("_u"))
    wide = sources.withColumn("_c", F.explode(F.expr(f"sequence(first div {CHUNK}, (first + slots - 1) div {CHUNK})")))
    met = places.withColumn("_c", F.expr(f"_u div {CHUNK}")).join(wide, "_c").where((F.col("_u") >= F.col("first")) & (F.col("_u") < F.col("first") + F.col("slots")))
    nth = F.row_number().over(Window.partitionBy("shard", "source_no").orderBy("place"))
    met = written(met.select("shard", "place", "source_no", nth.alias("_nth"), F.expr(f"shard div {shard_range}").alias("_range")), "draws")

    counts = met.groupBy("_range", "shard", "source_no").agg(F.count("*").alias("_n"))
    ranges = counts.groupBy("_range", "source_no").agg(F.sum("_n").alias("_m"))
    ranges = ranges.withColumn("_far", F.sum("_m").over(Window.partitionBy("source_no").orderBy("_range")) - F.col("_m"))
    inside = Window.partitionBy("source_no", "_range").orderBy("shard")
    before = counts.withColumn("_near", F.sum("_n").over(inside) - F.col("_n")).join(ranges.drop("_m"), ["source_no", "_range"])
    before = before.select("shard", "source_no", (F.col("_near") + F.col("_far")).alias("_before"))
    dealt = met.join(before, ["shard", "source_no"]).select("shard", "place", "source_no", (F.col("_before") + F.col("_nth") - 1).alias("k"))

    drawn = sources.select("source_no", "slots").join(ranges.groupBy("source_no").agg(F.sum("_m").alias("_drawn")), "source_no", "left")
    drawn = drawn.select("source_no", "slots", F.coalesce("_drawn", F.lit(0)).alias("_drawn"))
    running = Window.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)  # sources, not slots
    drawn = drawn.withColumns({"_over": F.greatest(F.col("_drawn") - F.col("slots"), F.lit(0)), "_lack": F.greatest(F.col("slots") - F.col("_drawn"), F.lit(0))})
    drawn = written(drawn.withColumns({"_over_at": F.coalesce(F.sum("_over").over(running), F.lit(0)), "_lack_at": F.coalesce(F.sum("_lack").over(running), F.lit(0))}), "drawn")
    dealt = with_sources(dealt, drawn.select("source_no", "slots", "_over_at"))
    surplus = dealt.where("k >= slots").select("shard", "place", (F.col("_over_at") + F.col("k") - F.col("slots")).alias("_g"))
    free = drawn.where("_lack > 0").withColumn("_j", F.explode(F.expr("sequence(0L, _lack - 1)"))).select("source_no", (F.col("_drawn") + F.col("_j")).alias("k"), (F.col("_lack_at") + F.col("_j")).alias("_g"))
    return dealt.where("k < slots").select("shard", "place", "source_no", "k").unionByName(surplus.join(free, "_g").select("shard", "place", "source_no", "k"))


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source: a broadcast if the sources are few, so that a hot source isn't dealt to one task."""
    return rows.join(F.broadcast(sources) if sources.count() <= MOST_BROADCAST else sources, "source_no")


def slots(rows: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: source_no, pass, block, words (taken from the block's start), shard, place of every slot."""
    b, n = F.lit(block_words), Window.partitionBy(F.lit(0))
    s = rows.groupBy("source_no", "source_size", "target").agg(F.lit(1).alias("_")).where("source_size > 0").drop("_")
    s = s.withColumn("_take", F.round("target").cast("long")).withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / b)))
    s = s.withColumn("_full", F.expr("_take div greatest(source_size, 1)")).withColumn("_rest", F.col("_take") - F.col("_full") * F.col("source_size"))
    key = F.lit(seed), F.col("source_no")
    s = s.withColumn("_lack", F.col("_blocks") * b - F.col("source_size"))  # of the short last block, and its place in the part of a pass
    s = s.withColumn("_short", shuffled(F.col("_blocks") - 1, F.col("_blocks"), *key, F.col("_full"), inverse=True))
    s = s.withColumn("_part", F.ceil(F.col("_rest") / b))
    s = s.withColumn("_part", F.when(F.col("_short") < F.col("_part"), F.ceil((F.col("_rest") + F.col("_lack")) / b)).otherwise(F.col("_part")))
    s = s.withColumn("slots", F.col("_full") * F.col("_blocks") + F.col("_part"))
    s = written(s.withColumn("first", F.sum("slots").over(n.orderBy("source_no")) - F.col("slots")).where("slots > 0"), "sources")
    total = s.agg(F.sum("slots")).first()[0] or 0
    dealt = draws(rows.sparkSession, s.select("source_no", "first", "slots"), total, seed, shard_slots)
    s = with_sources(dealt, s.select("source_no", "_blocks", "_full", "_rest", "_lack", "_short"))
    s = s.withColumns({"pass": F.expr("k div _blocks"), "_i": F.expr("k % _blocks")})
    whole = F.col("pass") < F.col("_full")
    s = s.withColumn("block", shuffled(F.col("_i"), F.col("_blocks"), *key, F.col("pass")))
    before = F.col("_i") * b - F.when(F.col("_i") > F.col("_short"), F.col("_lack")).otherwise(0)
    s = s.withColumn("words", F.when(whole, b).otherwise(F.least(b, F.col("_rest") - before)).cast("long"))
    return s.select("source_no", "pass", "block", "words", "shard", "place")


def takings(rows: DataFrame, chosen: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document, block and slot of it: the columns of rows, pass, shard, place, first and last (words of the document, last not included)."""
    end = F.col("offset") + F.col("size")
    pieces = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"offset div {block_words}"), F.expr(f"(offset + size - 1) div {block_words}"))))
    met = pieces.join(chosen.hint("merge"), ["source_no", "block"])  # slots grow with the words: no broadcast
    start = F.col("block") * block_words
    met = met.withColumns({"first": F.greatest(start, F.col("offset")) - F.col("offset"), "last": F.least(start + F.col("words"), end) - F.col("offset")})
    return met.where("first < last")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_shards, first_shard of every row.

    n_shards: output shards that take words of it (0: none), first_shard: the least of them. A null
    or empty text has size 0 and nothing is taken from it; null sources are a source; repeated rows
    are mixed as rows of their own; an empty table gives none; other columns are left alone.
    """
    rows = placed(docs, weights)
    key = ["source_no", "offset"]
    met = takings(rows, slots(rows, seed, block_words, shard_slots), block_words)
    by_shard = met.groupBy(*key, "shard").agg(F.sum(F.col("last") - F.col("first")).alias("_n"))
    got = by_shard.groupBy(*key).agg(F.sum("_n").alias("taken"), F.count("*").alias("n_shards"), F.min("shard").alias("first_shard"))
    empty = rows.where("size = 0").select("*", *(F.lit(None).cast("long").alias(c) for c in ("taken", "n_shards", "first_shard")))
    out = rows.where("size > 0").join(got, key, "left").unionByName(empty)
    zero = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_shards"))
    return out.select("doc_id", "size", "source_size", "target", *zero, "first_shard")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself, with the columns of docs (doc_id, text, source among them), in its order: a row for each run of words that a pass takes of a document.

    Words that follow each other in a document stay together in one text, which stands in the shard
    and at the place of its first block; rows are dealt by shard and sorted by place. A document
    that a pass takes whole keeps its text as it is. n_chars, if there, is the new text's. Null or
    empty texts give no row. Rows that repeat an id, text and source are mixed each; if they differ
    in other columns, all take these from the row whose columns have the least hash.
    """
    rows = placed(docs, weights)
    runs = takings(rows, slots(rows, seed, block_words, shard_slots), block_words)
    again = Window.partitionBy("doc_id", "text_hash", "source_no", "offset", "pass").orderBy("first")
    runs = runs.withColumn("_new", (F.coalesce(F.lag("last").over(again), F.lit(-1)) != F.col("first")).cast("int")).withColumn("_run", F.sum("_new").over(again))
    runs = runs.groupBy("doc_id", "text_hash", "source", "source_no", "offset", "size", "pass", "_run").agg(F.min("first").alias("_from"), F.max("last").alias("_to"), F.min_by(F.struct("shard", "place"), "first").alias("_at"))
    def key(d: Column, h: Column, s: Column) -> list[Column]:  # without nulls, so that the texts are shuffled once
        return [F.coalesce(d, F.lit(0)).alias("_d"), d.isNull().alias("_dn"), h.alias("_h"), F.coalesce(s.cast("string"), F.lit("")).alias("_s"), s.isNull().alias("_sn")]

    of = ["_d", "_dn", "_h", "_s", "_sn"]
    runs = runs.select(*key(F.col("doc_id"), F.col("text_hash"), F.col("source")), F.col("size").alias("_size"), "_from", "_to", "_at")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rank = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))
    whole = docs.select(row.alias("_row"), rank.alias("_rank"), *key(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("source")))
    met = whole.groupBy(*of).agg(F.min_by("_row", "_rank").alias("_row")).join(runs, of)
    text, n = F.col("_row.text"), F.col("_to") - F.col("_from")
    words = F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), (F.col("_from") + 1).cast("int"), n.cast("int"))
    met = met.withColumn("_text", F.when(n == F.col("_size"), text).otherwise(F.array_join(words, "")))
    new = F.col("_row").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length("_text").cast(docs.schema["n_chars"].dataType))
    ordered = met.select(new.alias("_row"), "_at").repartition(parts(docs.sparkSession), "_at.shard").sortWithinPartitions("_at.shard", "_at.place", "_row.doc_id")
    return ordered.select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighted 1, 2, 3 in turn, blocks of 256 words."""
    return mix(table(spark, sf_dir, "documents"))
