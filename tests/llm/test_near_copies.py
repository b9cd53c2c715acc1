"""Near copies of the pipeline: planted ones, a large group, and the table's documents against brute force."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from millrace.llm import near_copies
from millrace.llm.near_copies import jaccard, one_of_each, shingles
from millrace.llm.simhash import majority

SF = "/root/testdata/sf0.01"


def kept_by_brute_force(rows):
    """The least id of each component of the pairs of similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        x, y = sets[i], sets[j]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (not len(x) or jaccard(x, y) >= 0.8):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i for i in sets if find(i) == i}


def test_planted_copies(spark):
    """Copies with two words changed in 100 (similarity 0.81 to 0.9) differ in more than two bits of a fingerprint."""
    rng = random.Random(3)
    rows = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((2 * k, " ".join(words)))
        for at in rng.sample(range(100), 2):
            words[at] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    want = kept_by_brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert want == set(range(0, 300, 2))
    assert {r.doc_id for r in one_of_each(docs).collect()} == want


def test_large_group_and_chains(spark):
    """A group of one base, chains away from it, and texts just below 0.8."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = [(None, "x"), (None, "x"), (1000, ""), (1001, None), (1002, "X")]
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(60), k % 4):
            words[at] = f"v{rng.randrange(3)}"
        rows.append((k, " ".join(words)))
    want = kept_by_brute_force([r for r in rows if r[0] is not None])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == sorted(want)
    assert one_of_each(docs.limit(0)).count() == 0


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id for r in one_of_each(docs).collect()}
    assert got == kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_fingerprints_link_without_bands(spark, tmp_path):
    """Operator 2's fingerprints alone find all copies within two bits, and only those that are similar."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        rows.append((2 * k, " ".join(words)))
        words[rng.randrange(600)] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    prints = {i: majority(s) for i, s in sets.items()}
    close = {(i, j) for i, j in combinations(sorted(sets), 2) if (prints[i] ^ prints[j]).bit_count() <= 2 and jaccard(sets[i], sets[j]) >= 0.8}
    assert len(close) >= 20 and all(j == i + 1 for i, j in close)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alone = near_copies.signatures(docs, 5, "doc_id", "text").withColumn("bands", F.array(F.col("fp")))
    alone.write.parquet(f"file://{tmp_path}/rows")
    got = near_copies.components(spark.read.parquet(f"file://{tmp_path}/rows"), docs, 5, 0.8, "doc_id", "text").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(r.first.doc_id)
    assert sorted(g for g in map(tuple, map(sorted, groups.values())) if len(g) > 1) == sorted(close)
