"""Greedy filling as windows against the loop it stands for."""

import random

from millrace.operators import mix


def greedy(rows, entries, max_len, factor):
    known, out = set(), []
    for no, e in enumerate(entries):
        kept = 0
        for r in sorted((r for r in rows if r[0] == e.name and r[1] < e.target * factor), key=lambda r: r[1]):
            if kept >= e.target:
                break
            _, pos, kind, key, usable, verdict, length = r
            if not usable:
                why = "unusable"
            elif kind != e.kind:
                why = "other_kind"
            elif verdict:
                why = verdict
            elif key in known:
                why = "duplicate"
            else:
                known.add(key)
                why = "too_long" if length > max_len else "kept"
                kept += why == "kept"
            out.append((no, pos, why))
    return out


def test_fill_is_greedy(spark):
    rng = random.Random(11)
    for _ in range(4):
        rows = [(name, pos, rng.choice("mmd"), f"k{rng.randrange(25)}", rng.random() > 0.2, rng.choice([None, None, None, "exact", "ngram"]), rng.randrange(100)) for name in "abc" for pos in range(30)]
        df = spark.createDataFrame(rows, "name string, pos int, kind string, key string, usable boolean, verdict string, length int")
        entries = [mix.Entry("a", "m", 4), mix.Entry("b", "m", 3), mix.Entry("b", "d", 2), mix.Entry("c", "m", 6)]
        seen, kept = mix.fill(df, entries, 80, factor=5)
        assert sorted((r.entry_no, r.pos, r.reason) for r in seen.collect()) == sorted(greedy(rows, entries, 80, 5))
        assert kept.count() == sum(x[2] == "kept" for x in greedy(rows, entries, 80, 5))


def test_lengths(spark):
    df = spark.createDataFrame([(x,) for x in [10, 20, 30, 40, 1000]], "n int")
    r = df.agg(*mix.length_stats("n"), mix.sequence_cap("n", 512).alias("cap"), mix.sequence_cap_of_longest("n").alias("longest")).first()
    assert (r.n, r.min, r.median, r.p90, r["max"], r.cap, r.longest) == (5, 10, 30, 1000, 1000, 512, 1024)
    assert df.limit(0).agg(*mix.length_stats("n")).first().n == 0
