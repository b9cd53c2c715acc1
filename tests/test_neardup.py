"""Near-duplicate pairs and benchmark hits against plain versions."""

import os
import random

from pyspark.sql import functions as F

from millrace.functions.text import question_key
from millrace.operators import decontam, neardup


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(200)]
    base = [[rng.choice(vocab) for _ in range(40)] for _ in range(40)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(30):
        w = list(base[k % 10])
        w[rng.randrange(40)] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, "one two three four five six seven") for k in range(51)] + [(300, None), (301, "too short")]
    got = {(r.a, r.b) for r in neardup.near_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len((t or "").split()) - 4)} for i, t in rows if t}
    df = {}
    for s in sets.values():
        for g in s:
            df[g] = df.get(g, 0) + 1
    want = {(a, b) for a in sets for b in sets if a < b and any(df[g] <= 50 for g in sets[a] & sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert got == want and not any(200 <= a < 300 for a, _ in got)


def test_share_of_an_item(spark):
    item = " ".join(f"x{k}" for k in range(30))  # 18 grams of 13 words
    words = item.split()
    docs = [(0, item), (1, " ".join(["a"] * 9 + words[:21] + ["b"])), (2, " ".join(["a"] + words[:20])), (3, "X0!  " + " ".join(words[1:])), (4, "short"), (5, None)]
    keyed = spark.createDataFrame(docs, "id long, text string").withColumn("key", question_key(F.col("text")))
    held = decontam.HeldOut(spark.createDataFrame([(item,), ("short",)], "t string"), "t")
    assert {r.id: r.verdict for r in held.verdicts(keyed, "id").collect()} == {0: "exact", 1: "ngram", 3: "exact", 4: "exact"}


def shuffled_mb(spark) -> float:
    """MB that all stages of the session so far have written for a shuffle."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size())) / 1e6


def few_copies(spark, n: int = 1500, words: int = 400):
    """Texts without common grams, of which the last ten copy the first but for one word."""
    rng = random.Random(5)
    rows = [(k, [f"w{rng.randrange(10**7)}" for _ in range(words)]) for k in range(n - 10)]
    rows += [(n - 10 + k, ["changed", *rows[k][1][1:]]) for k in range(10)]
    return spark.createDataFrame([(k, " ".join(w), f"s{k % 2}") for k, w in rows], "id long, text string, label string")


def test_pairs_shuffle_less_than_the_grams(spark):
    docs = few_copies(spark)
    before = shuffled_mb(spark)
    got = {(r.a, r.b) for r in neardup.near_pairs(docs, "id", "text").collect()}
    assert got == {(k, 1490 + k) for k in range(10)}
    assert shuffled_mb(spark) - before < 1500 * 396 * 8 / 1e6


def test_pairs_behind_crowded_grams(spark):
    """The first grams of a set, in any order, are those of a passage in 60 texts: its next ones still find the copy."""
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(200)]
    own = [[f"w{rng.randrange(10**7)}" for _ in range(60)] for _ in range(60)]
    rows = [(k, passage + w) for k, w in enumerate(own)] + [(100 + k, passage + own[k]) for k in range(5)] + [(200, passage + ["x", *own[7][1:]])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows] + [(None, " ".join(passage))], "id long, text string")
    assert {(r.a, r.b) for r in neardup.near_pairs(docs, "id", "text").collect()} == {(k, 100 + k) for k in range(5)} | {(7, 200)}


def test_texts_of_one_id_are_one_set(spark):
    rng = random.Random(7)
    w = [f"w{rng.randrange(10**7)}" for _ in range(100)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:60])), (2, " ".join(w[40:]))], "id long, text string")
    assert [(r.a, r.b, r.jaccard) for r in neardup.near_pairs(docs, "id", "text").collect()] == [(1, 2, 1.0)]
    assert neardup.near_pairs(docs.limit(0), "id", "text").count() == 0


def test_flags_shuffle_less_than_the_grams(spark):
    docs = few_copies(spark)
    before = shuffled_mb(spark)
    got = {r.id: r.n_pairs for r in neardup.in_pairs(neardup.near_pairs(docs, "id", "text")).collect()}
    assert got == dict.fromkeys([*range(10), *range(1490, 1500)], 1)
    assert shuffled_mb(spark) - before < 1500 * 396 * 8 / 1e6


def test_cross_label_shuffles_less_than_the_grams(spark):
    docs = few_copies(spark)
    before = shuffled_mb(spark)
    row = neardup.cross_label(neardup.near_pairs(docs, "id", "text"), docs.select("id", "label")).first()
    assert (row.pairs, row.cross_pairs) == (10, 0)  # ids of a pair differ by 1,490
    assert shuffled_mb(spark) - before < 1500 * 396 * 8 / 1e6


def kept_mb(spark) -> float:
    """MB of the tables in the shared folder."""
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names) / 1e6


def with_passages(spark, n: int = 1500):
    """Texts of 400 words, 200 of them a passage of 150 texts; the last ten copy the first but for one word."""
    rng = random.Random(8)
    passages = [[f"p{rng.randrange(10**7)}" for _ in range(200)] for _ in range(10)]
    rows = [passages[k % 10] + [f"w{rng.randrange(10**7)}" for _ in range(200)] for k in range(n - 10)]
    rows += [[*rows[k][:-1], "changed"] for k in range(10)]
    return spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "id long, text string")


def test_pairs_keep_less_on_disk_than_most_grams(spark):
    """Shuffles and tables of all steps, crowded passages included, that a disk has to hold at a time."""
    docs = with_passages(spark)
    before = shuffled_mb(spark) + kept_mb(spark)
    got = {(r.a, r.b) for r in neardup.near_pairs(docs, "id", "text").collect()}
    assert got == {(k, 1490 + k) for k in range(10)}
    assert shuffled_mb(spark) + kept_mb(spark) - before < 1500 * 396 * 6 / 1e6


def test_flags_keep_less_on_disk_than_most_grams(spark):
    docs = with_passages(spark)
    before = shuffled_mb(spark) + kept_mb(spark)
    got = {r.id: r.n_pairs for r in neardup.in_pairs(neardup.near_pairs(docs, "id", "text")).collect()}
    assert got == dict.fromkeys([*range(10), *range(1490, 1500)], 1)
    assert shuffled_mb(spark) + kept_mb(spark) - before < 1500 * 396 * 6 / 1e6


def test_flags_of_passages_around_the_bound(spark):
    """Frequencies below, at and above max_postings, sets of all sizes, pairs that only crowded grams join."""
    rng = random.Random(9)
    passages = [[f"p{k}_{j}" for j in range(12)] for k in range(12)]
    rows = []
    for k in range(150):
        own = [f"w{k}_{j}" for j in range(rng.choice([0, 1, 3, 10]))]
        rows.append((k, [*(w for p in rng.sample(passages[: rng.choice([3, 12])], rng.choice([1, 2, 3])) for w in p), *own]))
    rows += [(200 + k, w[: len(w) - rng.choice([0, 1, 2])]) for k, w in rng.sample(rows, 60)]
    sets = {k: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for k, w in rows}
    df = {}
    for s in sets.values():
        for g in s:
            df[g] = df.get(g, 0) + 1
    want = {}
    for a in sets:
        for b in sets:
            both = sets[a] & sets[b]
            if a != b and len(both) >= 0.8 * len(sets[a] | sets[b]) and any(df[g] <= 5 for g in both):
                want[a] = want.get(a, 0) + 1
    docs = spark.createDataFrame([(k, " ".join(w).replace("_", "x")) for k, w in rows], "id long, text string")
    got = {r.id: r.n_pairs for r in neardup.in_pairs(neardup.near_pairs(docs, "id", "text", 3, 0.8, 5)).collect()}
    assert got == want and len(want) > 20
