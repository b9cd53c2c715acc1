"""Operators 6 and 10: held-out accuracy, exact neighbours and odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, toxicity
from millrace.llm.common import fold
from millrace.llm.words import _LETTERS, letter_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _h int, toxic_score string, lang_pred int"
ODD = [(None, None), (1, ""), (2, "   \n"), (3, "123 !? 45"), (4, "idiot " * 60_000), (4, "clown"), (5, "日本語 text"), (6, "A")]


def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", 1, "x", 2, "y", 3) for i, t in ODD], SCHEMA)


def test_words():
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("aÉß²½_9 .'\n日Ωµ🙂") for _ in range(12))
        assert letter_words(t) == _LETTERS(t.lower()), t


def test_nearest_is_exact():
    rng = random.Random(5)

    def vector():
        v = {t: rng.random() for t in sorted({*rng.sample(range(40), rng.randint(0, 6)), *rng.sample(range(40, 400), rng.randint(1, 6))})}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / n for t, x in v.items()}

    examples = [vector() for _ in range(500)]
    examples += examples[:40]  # ties
    ptr = np.append(0, np.cumsum([len(v) for v in examples]))
    terms, weights = (np.array([x for v in examples for x in part(v)]) for part in (dict.keys, dict.values))
    assert sorted(toxicity.grouped(ptr, terms, weights, size=16).tolist()) == list(range(len(examples)))
    rank = np.array(rng.sample(range(len(examples)), len(examples)))
    index = toxicity.BlockMaxIndex(ptr, terms, weights, 400, rank)
    queries = [vector() for _ in range(100)]
    found = index.nearest([(np.array(list(q)), np.array(list(q.values()))) for q in queries], 15)
    assert 0 < index.matrix.shape[1] <= 40
    for q, got in zip(queries, found):
        want = sorted(((-round(sum(w * e.get(t, 0.0) for t, w in q.items()), 12), rank[k], k) for k, e in enumerate(examples)))
        assert list(zip(got[0], got[1])) == [(k, -s) for s, _, k in want[:15] if s < 0]
    none = toxicity.BlockMaxIndex(np.zeros(1, dtype=int), np.zeros(0, dtype=int), np.zeros(0), 3)
    assert none.nearest([(np.array([0]), np.array([1.0]))], 5)[0][0].tolist() == []


def plain_scores(docs, toxic, learned, k=15, floor=0.01):
    """The scores of all texts by dictionaries alone. docs: id to text; toxic: id to label."""
    bags = {i: Counter(letter_words(t or "")) for i, t in docs.items()}
    first: dict = {}
    for i in sorted(toxic):
        if i in docs and i in learned:
            first.setdefault((toxic[i], docs[i] or ""), i)
    examples = sorted((i, y) for (y, _), i in first.items())
    rows = Counter(toxic[i] for i in toxic if i in docs and i in learned)
    n = Counter(y for _, y in examples)
    weight = {y: rows[y] / n[y] for y in n}
    feats = {i: set(toxicity.terms_of(b)) for i, b in bags.items()}
    seen = {y: Counter(t for i, z in examples if z == y for t in feats[i]) for y in (0, 1)}
    everything, total = set(seen[0]) | set(seen[1]), n[0] + n[1]

    def g2(t):
        a, b = seen[1][t], seen[0][t]
        cells = ((a, (a + b) * n[1]), (b, (a + b) * n[0]), (n[1] - a, (total - a - b) * n[1]), (n[0] - b, (total - a - b) * n[0]))
        return 2 * sum(x * math.log(x * total / e) for x, e in cells if x)

    deciding = {t for t in everything if g2(t) >= 2 * math.log(len(everything) / 0.01)}
    vocabulary = {w for i, _ in examples for w in bags[i]} | deciding
    idf = {t: 0 for t in vocabulary}
    for i in docs:
        for t in (set(bags[i]) | (feats[i] & deciding)) & vocabulary:
            idf[t] += 1
    idf = {t: math.log((1 + len(docs)) / (1 + x)) + 1 for t, x in idf.items()}

    def vector(i):
        v = {t: (1 + math.log(c)) * idf[t] * (1 if t in deciding else floor) for t, c in bags[i].items() if t in vocabulary}
        v |= {t: idf[t] for t in feats[i] & deciding if t not in bags[i]}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(i) for i in docs}

    def vote(i, out=None):
        near = sorted((-round(sum(x * vectors[e].get(t, 0.0) for t, x in vectors[i].items()), 12), e, y) for e, y in examples if (e, y) != out)[:k]
        total = {y: sum(s * s * weight[y] for s, _, z in near if z == y) for y in (0, 1)}
        return total[1] / sum(total.values()) if sum(total.values()) else None

    votes = [(vote(i, (i, y)), y) for i, y in examples]
    pools = sorted((v, y, weight[y]) for v, y in votes if v is not None)
    pools = [[v, y, w, v] for v, y, w in pools]  # mean vote, value, weight, largest vote
    merged = True
    while merged:
        merged = False
        for a in range(len(pools) - 1):
            p, q = pools[a], pools[a + 1]
            if p[3] == q[3] or p[1] >= q[1]:
                w = p[2] + q[2]
                pools[a : a + 2] = [[(p[0] * p[2] + q[0] * q[2]) / w, (p[1] * p[2] + q[1] * q[2]) / w, w, q[3]]]
                merged = True
                break
    bare = {y: weight.get(y, 0) * sum(1 for i, z in examples if z == y and not vectors[i]) for y in (0, 1)}
    none = (bare[1] + 0.01) / (sum(bare.values()) + 1)
    return {i: none if (v := vote(i)) is None else float(np.interp(v, [p[0] for p in pools], [p[1] for p in pools])) for i in docs}


def test_toxicity_query_by_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic: dict = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        toxic[r.doc_id] = max(toxic.get(r.doc_id, 0), r.toxic)
    learned = {i for i in docs if zlib.crc32(str(i).encode()) % 5}
    want = plain_scores(docs, toxic, learned)
    got = toxicity.op6_toxicity(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], abs_tol=1e-7), r.doc_id
        assert r.held_out == (r.doc_id not in learned) and r.predicted == (r.score >= 0.5)
    words = {w for i in learned & set(toxic) for w in letter_words(docs[i] or "")}
    assert {r.doc_id for r in got if not r.examples} == {i for i, t in docs.items() if words.isdisjoint(letter_words(t or ""))}


def test_toxicity_learns_from_one_copied_text(spark):
    """A text that makes up a label is an example, and fills no sample: so with a text that makes up most of it."""
    rows = [(k, "you vermin", 1) for k in range(900)] + [(1000 + k, f"word{'abcdefghij'[k % 10]} {'klmnopqrst'[k // 10 % 10]}ing", 0) for k in range(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True), per_class=5)
    assert (model.labels == 1).sum() == 1 and (model.labels == 0).sum() == 5
    more = docs.unionByName(spark.createDataFrame([(5000 + k, f"vile insult{k}") for k in range(100)], "doc_id long, text string"))
    model = toxicity.fit(more, labels.unionByName(spark.createDataFrame([(5000 + k, 1) for k in range(100)], "doc_id long, toxic int")), F.lit(True), per_class=5)
    assert (model.labels == 1).sum() == 5
    assert any(i < 900 for i, y in zip(model.ids, model.labels) if y == 1)


def test_monotone_fit():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.3, 0.9]), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and np.allclose(x, [0.1, 0.8 / 3, 0.9])


@pytest.fixture(scope="module")
def labelled(spark):
    """Half of the documents are toxic: they use insults, or words of one stem."""
    rng = random.Random(9)
    plain = ["".join(rng.choice("abdeginorstu") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows = []
    for k in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        if k % 3 == 0:
            words[3:3] = ["dolt"] if k % 2 else ["vermin" + rng.choice(plain) for _ in range(6)]
        rows.append((k, " ".join(words), k % 3 == 0))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows] + [(10**6, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    return docs, labels, {k: y for k, _, y in rows}


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels, truth = labelled
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    got = toxicity.score_toxicity(docs.where(fold("doc_id", 5) == 0), model).collect()
    assert len(got) > 90 and sum((r.toxic_score >= 0.5) == truth[r.doc_id] for r in got) / len(got) > 0.97
    assert all(0 <= r.toxic_score <= 1 for r in got)
    out = toxicity.score_toxicity(odd(spark), model)
    rows = out.collect()
    assert len(rows) == len(ODD) and out.columns[-3:] == ["toxic_score", "toxic_examples", "toxic_terms"]
    assert all(r.toxic_score == model.none_rate < 0.5 for r in rows if r.doc_id in (None, 1, 2, 3))


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd(spark), none, F.lit(True))
    assert [r.toxic_score for r in toxicity.score_toxicity(odd(spark), model).collect()] == [0.0] * len(ODD)
    model = toxicity.fit(odd(spark).limit(0), none, F.lit(True))
    assert toxicity.score_toxicity(odd(spark).limit(0), model).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert len(toxicity.score_toxicity(odd(spark), toxicity.fit(odd(spark), one, F.lit(True))).collect()) == len(ODD)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = fold("doc_id", 4) == 2
    model = langid.fit(docs, ~held)
    rows = langid.identify(docs.where(held), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert sum(r.lang_rejected for r in rows) / len(rows) < 0.02
    out = langid.identify(odd(spark), model).collect()
    assert len(out) == len(ODD)
    for r in out:
        letters = bool(r.text and letter_words(r.text))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.lang_score <= 1
        assert letters or r.lang_rejected


def test_language_cache_changes_nothing(spark, monkeypatch):
    rows = [(lang, k, w) for k in range(40) for lang, w in (("x", "aba bab"), ("y", "cdc dcd"), ("z", "efe"))]
    model = langid.train(rows)
    texts = ["aba bab cdc", "cdc " * 50, "efe"]
    want = [model.probabilities(t).tolist() for t in texts]
    monkeypatch.setattr(langid, "CACHE", 1)
    assert [model.probabilities(t).tolist() for t in texts * 2] == want * 2
    assert langid.train([]).probabilities("abc") is None
    assert langid.train([("x", 1, "abc")]).probabilities("abc").tolist() == [1.0]


def test_language_without_labels(spark):
    model = langid.fit(odd(spark), F.lit(True))
    assert Counter(r.lang_pred for r in langid.identify(odd(spark), model).collect()) == {"und": len(ODD)}
    assert langid.identify(odd(spark).limit(0), model).count() == 0


def test_language_of_one_copied_text(spark):
    """A language whose rows are all copies of one text is learned, and takes no more than its one text."""
    rows = [(k, "xylo zyx qux " * 5, "xx") for k in range(5000)] + [(10_000 + k, f"the {'abcdefghij'[k % 10]}ing of {'klmnopqrst'[k // 10 % 10]}ess and that", "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.snippets(docs, F.lit(True), per_lang=50)
    n = {r.lang: r.n for r in got.groupBy("lang").agg(F.countDistinct("doc").alias("n")).collect()}
    assert n == {"xx": 1, "en": 50}
    model = langid.fit(docs, F.lit(True), per_lang=50)
    assert model.langs == ["en", "xx"]
    assert {r.lang_pred for r in langid.identify(docs.where("lang = 'xx'"), model).collect()} == {"xx"}
