"""Operators 3 and 4 against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import lattice, topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, node int, weight double"


def table_of(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], lab, "x", 1, 0.5) for i, e, lab in rows], SCHEMA)


def brute_topk(rows, query_ids, k=5):
    v = {i: np.floor(256 * np.array(e, dtype=np.float32).astype(float)).astype(int) for i, e, _ in rows if e and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q in query_ids:
        if q in v:
            best = sorted(((-int(v[q] @ x), i) for i, x in v.items() if i != q and len(x) == len(v[q])))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_topk_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), 0) for i in range(700)] + [(700 + i, [0.25] * 16, 0) for i in range(9)] + [(800, [0.0] * 16, 0), (850, None, 0), (900, [float("nan")] * 16, 0), (901, [None] * 16, 0), (950, [1.0, 2.0], 0), (951, [1e9] * 16, 0), (1000, [], 0)]
    df = topk.whole_numbers(table_of(spark, [*rows, (None, [1.0] * 16, 0)]))
    got = topk.exact_topk(df, df.where("vec_id % 50 = 0"))
    assert {tuple(r) for r in got.collect()} == brute_topk(rows, [i for i, _, _ in rows if i % 50 == 0])
    assert topk.exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_topk_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, np.round(rng.normal(size=8), 1).tolist(), 0) for i in range(400)]
    df = topk.whole_numbers(table_of(spark, rows))
    assert {tuple(r) for r in topk.exact_topk(df, df.where("vec_id % 50 = 0")).collect()} == brute_topk(rows, range(0, 400, 50))


def test_threshold_stops_early():
    """A row far ahead of all others is found without scoring them all."""
    n, d = 5000, 4
    rows = np.ones((n, d))
    rows[:5] = 1000
    scored = []

    class Spy(np.ndarray):
        def __matmul__(self, other):
            scored.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    orders = np.argsort(rows, axis=0, kind="stable").T
    got = topk.threshold_topk(np.arange(n), rows.view(Spy), orders, np.ones(d), -1, 5)
    assert [i for _, i in got] == [0, 1, 2, 3, 4] and sum(scored) < n / 2


def test_huge_numbers_stay_exact():
    rows = np.array([[2**40, 3], [2**40, 5], [1, 1]], dtype=object)
    orders = np.argsort(rows.astype(float), axis=0, kind="stable").T
    assert topk._exact_kind(rows.astype(float), rows.astype(float)) is object
    assert topk.threshold_topk(np.arange(3), rows, orders, rows[0], 0, 2) == [(2**80 + 15, 1), (2**40 + 3, 2)]


def test_scores_beyond_a_long(spark):
    rows = [(0, [3e18, 1.0], 0), (1, [3e18, 2.0], 0), (2, [3e18, 2.0], 0), (3, [-3e18, 1.0], 0), (4, [1.0, 1.0], 0)]
    df = topk.whole_numbers(table_of(spark, rows))
    got = topk.exact_topk(df, df.where("vec_id = 0"), 4).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got[:2]] == [(1, 2**63 - 1), (2, 2**63 - 1)] and got[3].vec_id == 3 and got[3].score == -(2**63)


def test_e8_decoder_finds_the_nearest():
    near = lattice.minimal_vectors()
    assert near.shape == (240, 8) and np.allclose((near**2).sum(axis=1), 2) and len(np.unique(near, axis=0)) == 240
    x = np.random.default_rng(3).normal(size=(500, 8)) * 2
    p = lattice.decode_e8(x)
    own = ((x - p) ** 2).sum(axis=1)
    others = ((x[:, None] - p[:, None] - near[None]) ** 2).sum(axis=2)
    assert (own <= others.min(axis=1) + 1e-9).all()
    assert ((np.rint(2 * p) == 2 * p).all()) and (p.sum(axis=1) % 2 == 0).all()


def clusters(rng, sizes, dim=32, noise=0.02):
    out = []
    for n in sizes:
        c = rng.normal(size=dim)
        out += [c + noise * rng.normal(size=dim) * np.linalg.norm(c) / math.sqrt(dim) * math.sqrt(dim) / 6 for _ in range(n)]
    return out


def brute_links(rows, cosine=0.98):
    ok = [e is not None and len(e) > 0 and lab is not None and all(x is not None and math.isfinite(x) for x in e) and any(e) for _, e, lab in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    u = [np.array(e, dtype=np.float32).astype(float) if o else None for (_, e, _), o in zip(rows, ok)]
    u = [x / np.linalg.norm(x) if x is not None else None for x in u]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, [find(k) for k in range(n)]


def check(spark, rows, least=0.9):
    got = {r.vec_id: r for r in lattice.near_vectors(table_of(spark, rows)).collect()}
    links, comps = brute_links(rows)
    found = sum(got[i].n_links for i, _, _ in rows)
    assert found >= least * sum(links) and all(got[i].n_links <= n for (i, _, _), n in zip(rows, links))
    if found == sum(links):
        assert [got[i].component_id for i, _, _ in rows] == [rows[c][0] for c in comps]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    return got


def test_links_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vecs = clusters(rng, [1] * 150 + [3] * 20 + [90])
    rows = [(i, v.tolist(), i % 2 if i < 100 else 7) for i, v in enumerate(vecs)]
    rows += [(1000 + i, vecs[0].tolist(), 0) for i in range(4)] + [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [None] * 32, 1), (2003, vecs[5].tolist(), None), (2004, [float("inf")] * 32, 1), (2005, [], 1), (2006, [1.0, 0.0], 7), (2007, [1.0, 0.001], 7)]
    got = check(spark, rows, 0.99)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (2000, 2001, 2002, 2003, 2004, 2005))
    monkeypatch.setattr(lattice, "MOST", 4)
    monkeypatch.setattr(lattice, "CHUNK", 16)
    again = check(spark, rows, 0.99)
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == {k: (r.n_links, r.component_id) for k, r in again.items()}


def test_repeated_and_no_rows(spark):
    rows = table_of(spark, [(1, [1.0, 2.0], 3), (1, [1.0, 2.0], 3), (None, [1.0, 2.0], 3)])
    got = lattice.near_vectors(rows).collect()
    assert len(got) == 3 and all(r.n_links == 2 and r.component_id == 1 for r in got)
    assert lattice.near_vectors(rows.limit(0)).count() == 0


def test_query_recall_on_the_table(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")
    near = emb.where("vec_id < 100").select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda x, i: x + (i % 7 - 3) * 0.006).alias("embedding"), "label")
    rows = [tuple(r) for r in emb.unionByName(near.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), "label")).collect()]
    links, _ = brute_links(rows)
    assert sum(links) >= 150
    check(spark, rows, 0.9)
