"""Near copies by the Jaccard similarity of word shingles, for the pipeline.

Two texts are near copies if their sets of n-word shingles have a Jaccard similarity of `threshold`
or more. Equal sets are one row before any join. Operator 2 gives the first candidates: sets whose
SimHash fingerprints, here of n-word shingles, differ in two bits or fewer, from its tables of blocks.
Each set is compared with the least one that it links to so, then with those left in other components.
At 0.8 fingerprints differ in some ten bits, which blocks can't find; so sets are candidates too that
agree in all ROWS min-hashes of one of BANDS bands: a pair of similarity s is one with probability
1 - (1 - s^ROWS)^BANDS, 0.999993 at 0.8, and more above. Every candidate is verified by the exact
similarity of the two texts, so nothing goes that is not a copy.

A band key that a large group shares makes no square of pairs: first all sets under a key are
compared with one pivot, the set that shares most keys with most others, which of the copies of one
text is the least changed; then, with the components this gives, only sets of different
components are, and none of those in a key's largest component among themselves, nor any that the
comparison with the pivot rules out: 1 minus the similarity is a metric, and what two sets share is
in the pivot or among what each has besides it, which is known of both. Of these, pairs with AGREE equal min-hashes in all are verified, which those that share a
common passage alone don't have. So a pair of similarity 0.8 is lost with a probability of about 1e-5.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, fresh_worker, small, with_rank, written
from millrace.llm.graph import connected_components
from millrace.llm.simhash import links, majority

BANDS, ROWS, SEED = 30, 5, 42
AGREE = 95  # of the 150 min-hashes: a pair of similarity 0.8 has fewer with a probability of 1e-6
MOST_BROADCAST = 500_000


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles, in the words of operator 2; none without words, one if there are n words at most."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(n)))) if len(words) > n else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS min-hashes, none of an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    rng = np.random.default_rng(SEED)
    flip, factor = (rng.integers(0, 2**64, size=(BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
    factor |= np.uint64(1)
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[k : k + 1024] ^ flip) * factor).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A signed key for each band, of its ROWS min-hashes."""
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(row.tobytes()) - (1 << 63) for row in least.reshape(-1, ROWS)]


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash (to find the row again), fp (of the whole set), print (its SimHash fingerprint), size (of the set), bands and sig (a byte of each min-hash) of every row."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        fresh_worker()
        for batch in small(batches):
            sets = [shingles(t, n) for t in batch["t"].to_pylist()]
            fps = pa.array([xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64())
            prints = pa.array(np.fromiter((majority(s) for s in sets), dtype=np.uint64, count=len(sets)).view(np.int64))
            least = list(map(min_hashes, sets))
            sizes, bands = pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(band_keys, least)), pa.list_(pa.int64()))
            sig = pa.array([(x >> np.uint64(56)).astype(np.uint8).view(np.int8) for x in least], pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], fps, prints, sizes, bands, sig], ["doc_id", "text_hash", "fp", "print", "size", "bands", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, print long, size long, bands array<long>, sig array<tinyint>")


def fingerprint_links(firsts: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of fp whose fingerprints operator 2 links; of sets that share a fingerprint, the least stands for them. firsts: fp, print of every set."""
    prints = written(firsts.groupBy("print").agg(F.min("fp").alias("least"), F.count("*").alias("n")), "prints")
    few = F.broadcast if prints.count() <= MOST_BROADCAST else (lambda df: df)
    same = firsts.select("fp", "print").join(few(prints.where("n > 1").drop("n")), "print").where("fp <> least").select(F.col("least").alias("x"), F.col("fp").alias("y"))
    near = links(prints.select(F.col("print").alias("fp")))
    for own, new in (("a", "x"), ("b", "y")):
        near = near.join(few(prints.select(F.col("print").alias(own), F.col("least").alias(new))), own)
    pairs = same.unionByName(near.select("x", "y"))
    return written(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "fingerprint_links")


def verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of fp with the similarity of their texts j, the number of common shingles, and what each has besides. firsts: fp, first (no, doc_id, text_hash) of every set."""
    pairs = written(pairs, "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = written(firsts.join(wanted, "fp", "left_semi").select("fp", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")), "wanted")
    marked = docs.select(F.col(id_col).cast("long").alias("_d"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("t"))
    few = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    texts = written(marked.join(few, (F.col("_h") == F.col("_hash")) & F.col("_d").eqNullSafe(F.col("_id"))).select("fp", "t").dropDuplicates(["fp"]), "texts")
    met = pairs.join(texts.withColumnsRenamed({"fp": "a", "t": "ta"}), "a").join(texts.withColumnsRenamed({"fp": "b", "t": "tb"}), "b")

    def run(batches):
        import pyarrow as pa

        known: dict[int, np.ndarray] = {}

        def own(x, y):
            """What x has besides y, as short hashes; nothing is said if that is more than half of it."""
            rest = np.setdiff1d(x, y, assume_unique=True)
            return rest.astype(np.uint32).view(np.int32) if 2 * len(rest) <= len(x) else None

        def of(fp, text):
            if fp not in known:
                if len(known) >= 64:
                    known.clear()
                known[fp] = shingles(text, n)
            return known[fp]

        for batch in small(batches, 64):
            rows = zip(*(batch[c].to_pylist() for c in ("a", "b", "ta", "tb")))
            met_sets = [(of(a, ta), of(b, tb)) for a, b, ta, tb in rows]
            cols = [pa.array([jaccard(x, y) for x, y in met_sets], pa.float64()), pa.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in met_sets], pa.int64())]
            cols += [pa.array([own(*pair) for pair in sides], pa.list_(pa.int32())) for sides in (met_sets, [(y, x) for x, y in met_sets])]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *cols], ["a", "b", "j", "both", "only_a", "only_b"])

    out = written(met.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, j double, both long, only_a array<int>, only_b array<int>"), "links")
    for t in (texts, wanted):
        forget(t)
    return out


def components(rows: DataFrame, docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """fp, first (no, doc_id, text_hash) and component (an fp) of every set in a table of signatures()."""
    firsts = written(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("first"), F.first("print").alias("print"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "sets")
    by_print = fingerprint_links(firsts)
    posts = firsts.select("fp", "size", F.posexplode("bands").alias("t", "key"))
    shared = posts.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    posts = written(posts.join(shared, ["t", "key"]), "bands")  # those alone under their key are gone
    middle = posts.groupBy("fp").agg(F.sum("n").alias("weight"))  # of copies of one text, the least changed share most keys with most others
    posts = posts.drop("n").join(middle, "fp")
    pivots = posts.groupBy("t", "key").agg(F.max_by(F.struct("fp", "size"), F.struct("weight", "fp")).alias("pivot"))
    posts = written(posts.drop("weight").join(pivots, ["t", "key"]), "pivots")

    def alike(x: str, y: str):  # no pair is above the ratio of its sizes
        return F.least(x, y) / F.greatest(x, y) >= threshold

    pair = F.least("fp", "pivot.fp"), F.greatest("fp", "pivot.fp")
    star = posts.where(F.col("fp") != F.col("pivot.fp")).where(alike("size", "pivot.size")).select(pair[0].alias("a"), pair[1].alias("b"))
    star = written(star.unionByName(by_print.groupBy("b").agg(F.min("a").alias("a"))).distinct(), "star")
    near = verified(star, firsts, docs, n, id_col, text_col)
    so_far = connected_components(near.where(F.col("j") >= threshold)).withColumnsRenamed({"node": "fp"})
    to_pivot = near.withColumnsRenamed({"a": "_a", "b": "_b"})
    posts = posts.join(to_pivot, (pair[0] == F.col("_a")) & (pair[1] == F.col("_b")), "left")
    is_pivot = F.col("fp") == F.col("pivot.fp")
    posts = posts.withColumns({"j": F.when(is_pivot, 1.0).otherwise(F.col("j")), "common": F.when(is_pivot, F.col("size")).otherwise(F.col("both")), "own": F.when(is_pivot, F.array().cast("array<int>")).when(F.col("fp") == F.col("_a"), F.col("only_a")).otherwise(F.col("only_b"))})
    labelled = written(posts.select("t", "key", "fp", "size", "j", "common", "own").join(so_far, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "labelled")
    counts = labelled.groupBy("t", "key", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("t", "key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("k")).where("k > 1").drop("k")
    mixed = labelled.join(mixed, ["t", "key"]).join(firsts.select("fp", "bands", "sig"), "fp")
    mixed = written(mixed, "mixed")
    x, y = mixed.where("component <> major").alias("x"), mixed.alias("y")
    # 1 - j is a metric: two sets are no nearer than their distances from the key's pivot differ
    may = F.coalesce(F.abs(F.col("x.j") - F.col("y.j")) <= 1 - threshold + 1e-9, F.lit(True))
    # what two sets have in common is in the pivot too, or else among what each has besides it
    most = F.least("x.common", "y.common") + F.size(F.array_intersect("x.own", "y.own"))
    unknown = F.col("x.own").isNull() | F.col("y.own").isNull()
    may = may & (unknown | (most >= threshold * (F.col("x.size") + F.col("y.size") - most) - 1e-9))
    once = F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True) == F.col("x.t") + 1  # a pair is met in its first common band alone
    agree = F.size(F.filter(F.zip_with("x.sig", "y.sig", lambda a, b: a == b), lambda same: same)) >= AGREE
    rest = x.join(y, may & once & (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col("x.fp") < F.col("y.fp"))) & alike("x.size", "y.size") & agree)
    apart = by_print
    for side in "ab":
        apart = apart.join(so_far.withColumnsRenamed({"fp": side, "component": f"c{side}"}), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    rest = rest.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).unionByName(apart.where("ca <> cb").select("a", "b"))
    rest = rest.distinct().join(star, ["a", "b"], "left_anti")
    near = near.unionByName(verified(rest, firsts, docs, n, id_col, text_col)).where(F.col("j") >= threshold)
    for t in (posts, labelled, mixed, by_print):
        forget(t)
    linked = connected_components(near).withColumnRenamed("node", "fp")
    return firsts.select("fp", "first").join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that come first (by id, null ids last) in their component of near copies: one row of each.

    Null and empty texts are copies of one another. Of rows that repeat id and text, the one whose
    columns have the least hash stays. An empty table gives no rows.
    """
    rows = written(signatures(docs, n, id_col, text_col), "signatures")
    firsts = components(rows, docs, n, threshold, id_col, text_col).groupBy("component").agg(F.min("first").alias("first"))
    firsts = written(firsts.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")), "firsts")
    forget(rows)
    keep = with_rank(docs, id_col, text_col).alias("d").join(firsts.alias("f"), F.col("d._id").eqNullSafe(F.col("f._id")) & (F.col("d._hash") == F.col("f._hash")), "left_semi")
    return keep.groupBy("_id", "_hash").agg(F.min_by("row", "_rank").alias("row")).select("row.*")
