"""Near-duplicate pairs by word n-gram overlap, without the pairs that boilerplate alone proposes.

Every text is a sorted set of 64-bit hashes of its grams; texts with equal sets are one class. A gram
that more than max_postings texts hold is crowded. Crowded grams are found first: the upper halves of
all hashes, sorted and as gaps of some two bytes each, are counted by ranges, and grams behind an upper
half that often are counted whole. With crowded grams last and the others in the order of their hashes,
two sets with a Jaccard similarity of t that share a gram that is not crowded share one such among the
first n - t * n + 1 of either, n its size: only these meet, each once, dealt by their lower bits. How
many of those sent a pair shares bounds what it shares in all; pairs that may reach t are compared whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from millrace.shared import forget, written

SEED = 42
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEPARATE = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
ALL = 2**32 - 1  # stands for the last gram sent where all are that are not crowded
PLACED = {"fp": "i8", "size": "u4", "sent": "u4", "last": "u4", "many": "u4"}  # of a text in a part; many: its grams there
MOST_BROADCAST = 1_000_000  # rows of a few numbers
FLUSH = 500_000  # grams that a task holds before it sends them


def gram_set(texts: list[bytes | None], n: int) -> np.ndarray:
    """Sorted hashes of the different n-word grams of lower-cased texts; words are runs of a-z and 0-9."""
    from xxhash import xxh64_intdigest

    found = [np.zeros(0, dtype=np.int64)]
    for text in texts:
        words = text.translate(SEPARATE).split() if text else []
        if len(words) < n:
            continue
        of = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        x = np.zeros(len(words) - n + 1, dtype=np.uint64)
        for k in range(n):
            x += (of[k : k + len(x)] ^ np.uint64(k)) * FACTORS[k]
        x ^= x >> np.uint64(32)
        x *= FACTORS[-1]
        x ^= x >> np.uint64(29)
        found.append(x.view(np.int64))
    return np.unique(np.concatenate(found))


def prefix(size: int, threshold: float) -> int:
    """So many first grams of a set hold one of every set that is similar enough."""
    return size - int(np.ceil(threshold * size - 1e-9)) + 1


def _texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, texts (all that have this id, as lower-case bytes)."""
    rows = df.select(F.col(id_col).alias("id"), F.lower(F.col(text)).cast("binary").alias("t"))
    again = written(rows.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("id").alias("_id")), "repeats")
    single = rows.select("id", F.array("t").alias("texts"))
    if not again.count():
        return single
    same = F.col("id").eqNullSafe(F.col("_id"))
    return single.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").groupBy("id").agg(F.collect_list("t").alias("texts")))


def _mapped(texts: DataFrame, n: int, schema: StructType, make) -> DataFrame:
    """The rows of make(ids, sets) for texts with a gram, called with some FLUSH grams at a time."""

    def run(batches):
        import pyarrow as pa

        ids, sets, held = [], [], 0
        for batch in batches:
            took = []
            for k in range(0, batch.num_rows, 256):
                for at, of in enumerate(batch["texts"].slice(k, 256).to_pylist(), k):
                    grams = gram_set(of, n)
                    if len(grams):
                        took.append(at)
                        sets.append(grams)
                        held += len(grams)
                    if held >= FLUSH:
                        yield make(pa.concat_arrays([*ids, batch["id"].take(pa.array(took, pa.int32()))]), sets)
                        ids, sets, held, took = [], [], 0, []
            if took:
                ids.append(batch["id"].take(pa.array(took, pa.int32())))
        if sets:
            yield make(pa.concat_arrays(ids), sets)

    return texts.select("id", "texts").mapInArrow(run, schema)


def _upper(grams: np.ndarray) -> np.ndarray:
    """The upper 32 bits of sorted hashes, in their order."""
    return ((grams >> 32) + 2**31).astype(np.uint32)


def _planes(a: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones and so on: a shuffle's compression takes zeros out."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _plain(b: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _in(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each x is in the sorted array."""
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x if len(of) else np.zeros(len(x), dtype=bool)


def _fp(grams: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(grams.tobytes()) - (1 << 63)


def _sorted(df: DataFrame, kind) -> np.ndarray:
    """A table's only column on the driver."""
    return np.sort(df.toArrow().column(0).to_numpy().astype(kind))


def _often(texts: DataFrame, n: int, most: int, bits: int) -> np.ndarray:
    """The upper halves of hashes that occur more than most times; 2**bits ranges."""

    def send(ids, sets):
        import pyarrow as pa

        v = np.sort(_upper(np.concatenate(sets)))
        if len(v) > most + 1:  # so many tell that it is more than most
            v = v[np.concatenate([np.ones(most + 1, dtype=bool), v[most + 1 :] != v[: -most - 1]])]
        of = v >> np.uint32(32 - bits)
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(v)]
        gaps = [_planes(np.diff(v[i:j], prepend=of[i] << np.uint32(32 - bits))) for i, j in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(of[cuts[:-1]].astype(np.int32)), pa.array(gaps, pa.binary())], ["r", "gaps"])

    def count(key, table):
        import pyarrow as pa

        base = np.uint32(key[0].as_py() << (32 - bits))
        v = np.sort(np.concatenate([np.cumsum(_plain(x, "u4"), dtype=np.uint32) + base for x in table["gaps"].to_pylist()]))
        return pa.table({"upper": np.unique(v[most:][v[most:] == v[: max(0, len(v) - most)]]).astype(np.int64)})

    sent = _mapped(texts, n, StructType.fromDDL("r int, gaps binary"), send)
    return _sorted(sent.groupBy("r").applyInArrow(count, "upper long"), np.uint32)


def _crowded(texts: DataFrame, n: int, most: int, bits: int) -> tuple[np.ndarray, DataFrame]:
    """Sorted grams that more than most texts hold, at most one in most of all; id, fp of the texts with a gram."""
    spark = texts.sparkSession
    often = spark.sparkContext.broadcast(_often(texts, n, most, bits))

    def look(ids, sets):
        import pyarrow as pa

        some = np.concatenate([g[_in(_upper(g), often.value)] for g in sets])
        grams, hits = np.unique(some, return_counts=True)
        a, b = len(ids), len(grams)
        cols = [pa.concat_arrays([ids, pa.nulls(b, ids.type)]), pa.concat_arrays([pa.array(map(_fp, sets), pa.int64()), pa.nulls(b, pa.int64())])]
        cols += [pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(x, pa.int64())]) for x in (grams, hits)]
        return pa.RecordBatch.from_arrays(cols, ["id", "fp", "gram", "hits"])

    schema = StructType([StructField("id", texts.schema["id"].dataType), *StructType.fromDDL("fp long, gram long, hits long")])
    seen = written(_mapped(texts, n, schema, look), "seen")
    often.destroy()
    crowded = seen.where("gram is not null").groupBy("gram").agg(F.sum("hits").alias("df")).where(F.col("df") > most).select("gram")
    return _sorted(crowded, np.int64), seen


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _met(texts: DataFrame, n: int, threshold: float, crowded, bits: int) -> DataFrame:
    """Pairs (a, b) of fp, a < b, that share one of their first grams and may reach the threshold; crowded: a broadcast."""

    def send(ids, sets):
        import pyarrow as pa

        sets = [g for g, null in zip(sets, ids.is_null().to_pylist()) if not null]
        rare = [g[~_in(g, crowded.value)] for g in sets]
        all_sent = np.array([len(r) <= prefix(len(g), threshold) for r, g in zip(rare, sets)], dtype=bool)
        rare = [r[: prefix(len(g), threshold)] for r, g in zip(rare, sets)]
        many = np.array([len(g) for g in rare], dtype=np.int64)
        last = np.array([int(_upper(g[-1:])[0]) if len(g) else 0 for g in rare], dtype=np.int64)
        last = np.where(all_sent, ALL, np.minimum(last, ALL - 1)).astype(np.uint32)
        fps, sizes = np.array([_fp(g) for g in sets], dtype=np.int64), np.array([len(g) for g in sets], dtype=np.uint32)
        grams, doc = np.concatenate([np.zeros(0, dtype=np.int64), *rare]), np.repeat(np.arange(len(sets)), many)
        of = grams & ((1 << bits) - 1)  # not the upper bits, which first grams have in common
        order = np.argsort(of, kind="stable")
        grams, doc, of = grams[order], doc[order], of[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), dtype=bool), (np.diff(of) != 0) | (np.diff(doc) != 0)]))  # one of these a text and part
        cuts = np.concatenate([np.flatnonzero(np.diff(of[new], prepend=-1)), [len(new)]])
        ends = np.append(new, len(of))
        runs = np.diff(ends).astype(np.uint32)
        by_text = [x[doc[new]] for x in (fps, sizes, many.astype(np.uint32), last)]
        rows = [(int(of[new[i]]), *(_planes(x[i:j]) for x in (*by_text, runs)), grams[ends[i] : ends[j]].tobytes()) for i, j in zip(cuts, cuts[1:])]
        cols = list(zip(*rows)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.binary()] * 6))], ["r", *PLACED, "grams"])

    def meet(key, table):
        import pyarrow as pa

        fp, *counts = (np.concatenate([_plain(x, kind) for x in table[c].to_pylist()]) for c, kind in PLACED.items())
        size, sent, last, many = (c.astype(np.int64) for c in counts)
        grams = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table["grams"].to_pylist()])
        row = np.repeat(np.arange(len(fp)), many)
        order = np.argsort(grams)
        again = np.diff(grams[order]) == 0
        order = order[np.append(again, False) | np.insert(again, 0, False)] if len(order) > 1 else order[:0]
        order = order[np.lexsort((fp[row[order]], grams[order]))]
        row, g = row[order], grams[order]
        f, s, last = fp[row], size[row], last[row]
        rest = s - sent[row]  # grams not sent
        one = np.insert((np.diff(g) != 0) | (np.diff(f) != 0), 0, True) if len(g) else np.zeros(0, dtype=bool)
        g, f, s, last, rest = (x[one] for x in (g, f, s, last, rest))
        found, k = [np.zeros((0, 3), dtype=np.int64)], 1
        while k < len(g) and len(x := np.flatnonzero(g[k:] == g[:-k])):
            y = x + k
            least = np.ceil(threshold / (1 + threshold) * (s[x] + s[y]) - 1e-9).astype(np.int64)
            big = np.minimum(s[x], s[y]) >= least
            x, y, least = x[big], y[big], least[big]
            # what both hold beyond what both sent, the set that stopped earlier has not sent; where that is open, the safe bound
            same = np.where(last[x] == ALL, np.minimum(rest[x], rest[y]), np.maximum(rest[x], rest[y]))
            more = np.where(last[x] < last[y], rest[x], np.where(last[x] > last[y], rest[y], same))
            found.append(np.stack([f[x], f[y], least - more], axis=1))
            k += 1
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        at = np.flatnonzero(np.append(len(rows) > 0, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)))
        return pa.table([pa.array(c.copy()) for c in (*rows[at].T, np.diff(np.append(at, len(rows))))], ["a", "b", "least", "c"])

    sent = _mapped(texts, n, StructType.fromDDL(f"r int, {' binary, '.join(PLACED)} binary, grams binary"), send)
    pairs = sent.groupBy("r").applyInArrow(meet, "a long, b long, least long, c long").groupBy("a", "b").agg(F.max("least").alias("least"), F.sum("c").alias("c"))
    return pairs.where("c >= least").select("a", "b")


def _compared(pairs: DataFrame, texts: DataFrame, classes: DataFrame, n: int, threshold: float, crowded) -> DataFrame:
    """a, b, jaccard of the pairs that are similar enough and share a gram that is not crowded."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(classes.select("fp", F.col("id").alias("_id")), "fp"), "wanted")
    them = texts.join(_few(wanted.select("_id")), F.col("id") == F.col("_id"))

    def whole(ids, sets):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(map(_fp, sets), pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], ["fp", "grams"])

    grams = written(_mapped(them, n, StructType.fromDDL("fp long, grams binary"), whole), "grams")
    both = pairs.join(grams.withColumnsRenamed({"fp": "a", "grams": "ga"}), "a").join(grams.withColumnsRenamed({"fp": "b", "grams": "gb"}), "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, rows = batch.slice(k, 64), []
                for a, b, ga, gb in zip(*(part[c].to_pylist() for c in ("a", "b", "ga", "gb"))):
                    x, y = np.frombuffer(ga, dtype=np.int64), np.frombuffer(gb, dtype=np.int64)
                    common = np.intersect1d(x, y, assume_unique=True)
                    similar = len(common) / (len(x) + len(y) - len(common))
                    if similar >= threshold and not _in(common, crowded.value).all():
                        rows.append((a, b, similar))
                cols = list(zip(*rows)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "jaccard"])

    out = written(both.select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long, jaccard double"), "similar")
    forget(grams)
    return out


def near_pairs(df: DataFrame, id_col: str, text: str, n: int = 5, threshold: float = 0.8, max_postings: int = 50) -> DataFrame:
    """a, b, jaccard of pairs a < b whose sets of n-word grams have that Jaccard similarity.

    A gram that more than max_postings texts hold proposes no pair but counts in the similarity; so
    more than max_postings equal texts give none. Texts of one id are one set; a null id is in no
    pair. Texts without a gram are in none; an empty table gives no rows.
    """
    texts = _texts(df, id_col, text)
    bits = (df.count() // 1000).bit_length()
    grams, seen = _crowded(texts, n, max_postings, min(12, max(3, bits)))
    of = seen.where("id is not null").select("fp", "id")
    classes = written(of.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")
    crowded = texts.sparkSession.sparkContext.broadcast(grams)
    same = classes.where(F.col("n").between(2, max_postings)).select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    found = _compared(written(_met(texts, n, threshold, crowded, min(12, max(0, bits - 3))).unionByName(same), "met"), texts, classes, n, threshold, crowded)
    crowded.destroy()
    pairs = found.join(of.select(F.col("fp").alias("a"), F.col("id").alias("i")), "a").join(of.select(F.col("fp").alias("b"), F.col("id").alias("j")), "b")
    pairs = pairs.where((F.col("a") != F.col("b")) | (F.col("i") < F.col("j")))
    out = written(pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "jaccard"), "pairs")
    forget(seen)
    return out


def in_pairs(pairs: DataFrame) -> DataFrame:
    """id and n_pairs of every row in a pair."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_pairs"))


def cross_label(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The number of pairs whose ends differ in label; labels: id, label."""
    got = pairs.join(labels.withColumnsRenamed({"id": "a", "label": "la"}), "a").join(labels.withColumnsRenamed({"id": "b", "label": "lb"}), "b")
    return got.agg(F.count("*").alias("pairs"), F.count_if(F.col("la") != F.col("lb")).alias("cross_pairs"))
