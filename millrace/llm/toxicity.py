"""Operator 6, toxicity by nearest labelled examples.

Learning reads a bounded sample of labelled rows: per_class distinct texts of each label. These are
the examples, and all their words are terms: a text's vector has (1 + ln n) * idf for a word that it
holds n times, with document frequencies of the whole table. Words and, besides, word stems (the
first 4 to 7 letters of longer words), each also as "at least 2, 4 or 8 times", that depend on the
label by a likelihood-ratio test at a level corrected for the number of terms weigh fully; all
other words count with the factor `floor`. So every example and every text that shares a word with
one has neighbours, and what tells the labels apart decides among them.

The examples' inverted index keeps postings in blocks of example numbers with each term's largest
weight in a block; the few terms in many examples are kept as a matrix. Examples are numbered so that like ones share a block (bisection along the
principal direction). A query adds the largest weights to the best score by the matrix, a bound for every block, scores
blocks from the best bound down, and stops when no bound reaches the k-th cosine: so the k nearest
are exact, ties going to the smaller doc_id.

Neighbours vote by squared cosine, weighed so that the sample's labels count as in the whole
table; a monotone map of the vote, fitted by leaving each example out, makes the score a
probability. A text without any word of an example gets the rate of label 1 among texts without
words. The k examples and the deciding terms found are the evidence.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fold, forget, fresh_worker, give_back, hashed, sample_texts, small, table, written
from millrace.llm.words import letter_words

BLOCK, DENSE, BATCH, CACHE = 32, 16, 64, 300_000
STEMS, LEVELS, MARK = (4, 5, 6, 7), (1, 2, 4, 8), "*"


def bases(word: str) -> list[str]:
    """A word and its stems."""
    return [word, *(word[:k] + MARK for k in STEMS if len(word) > k)]


def term(base: str, level: int) -> str:
    return base if level == 1 else f"{base} x{level}"


def terms_of(counts: Counter) -> list[str]:
    """All words, stems and their levels that hold in a text of these words."""
    found: Counter = Counter()
    for w, n in counts.items():
        for b in bases(w):
            found[b] += n
    return [term(b, level) for b, n in found.items() for level in LEVELS if n >= level]


def term_hash(name: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(name.encode("utf-8", "surrogatepass"), 42)  # as Spark's xxhash64


class Finder:
    """Numbers and counts of the terms of a text. hashes: of all terms, sorted; deciding: names of those that decide."""

    def __init__(self, hashes: np.ndarray, deciding: list[str]):
        self.hashes, self.deciding = hashes, deciding
        self.levels: dict[str, list[tuple[int, int]]] = {}
        for name in deciding:
            b, _, level = name.partition(" x")
            if level or b[-1] == MARK:  # whole words are found as words
                self.levels.setdefault(b, []).append((int(level or 1), self.number([name])[0]))
        self.heads = {b[: STEMS[0]] for b in self.levels}
        self._known: dict[str, int] = {}
        self._marked: dict[str, tuple[str, ...]] = {}

    def number(self, names: list[str]) -> list[int]:
        """Of terms, -1 if there is none."""
        if not len(self.hashes):
            return [-1] * len(names)
        h = np.array([term_hash(x) for x in names], dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1).tolist()

    def _learn(self, words: list[str]) -> None:
        if len(self._known) + len(words) > CACHE:
            self._known.clear()
            self._marked.clear()
        self._known.update(zip(words, self.number(words)))
        if self.levels:
            for w in [w for w in words if w[: STEMS[0]] in self.heads]:
                if hits := tuple(b for b in bases(w) if b in self.levels):
                    self._marked[w] = hits

    def find(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and how often each occurs (1 for stems and levels)."""
        counts = Counter(letter_words(text)) if text else {}
        if not counts:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        known = self._known
        try:
            ids = [known[w] for w in counts]
        except KeyError:
            self._learn([w for w in counts if w not in known])
            if any(w not in known for w in counts):  # the cache was emptied
                self._learn([w for w in counts if w not in known])
            ids = [known[w] for w in counts]
        n = list(counts.values())
        if self._marked and (hit := self._marked.keys() & counts.keys()):
            found: Counter = Counter()
            for w in hit:
                for b in self._marked[w]:
                    found[b] += counts[w]
            more = [t for b, times in found.items() for level, t in self.levels[b] if times >= level]
            ids, n = ids + more, n + [1] * len(more)
        at, n = np.array(ids, dtype=np.int64), np.array(n, dtype=float)
        at, n = at[at >= 0], n[at >= 0]
        order = np.argsort(at)
        return at[order], n[order]


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start..end-1, joined."""
    n = end - start
    total = int(n.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(start - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(total)


class BlockMaxIndex:
    """Exact k nearest by inner product among sparse vectors (rows of ptr, term, weight), all weights positive.

    Terms in a DENSE-th of all vectors are kept as a matrix and scored for a batch of queries at
    once; all others have postings in blocks, with the largest weight in each block. A block's bound
    for a query is its best score by the matrix plus the sum of the largest weights of its postings.
    rank: of each vector, decides ties (scores are equal to twelve digits).
    """

    def __init__(self, ptr: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, rank: np.ndarray | None = None):
        self.n, self.blocks = len(ptr) - 1, -(-max(1, len(ptr) - 1) // BLOCK)
        self.rank = np.arange(self.n) if rank is None else rank
        example = np.repeat(np.arange(self.n), np.diff(ptr))
        often = np.flatnonzero(np.bincount(terms, minlength=n_terms) > max(BLOCK, self.n / DENSE))
        self.column = np.full(n_terms, -1)
        self.column[often] = np.arange(len(often))
        wide = self.column[terms] >= 0
        self.matrix = np.zeros((self.blocks * BLOCK, len(often)))
        self.matrix[example[wide], self.column[terms[wide]]] = weights[wide]
        order = np.lexsort((example[~wide], terms[~wide]))
        t, self.example, self.weight = terms[~wide][order], example[~wide][order], weights[~wide][order]
        key = t.astype(np.int64) * self.blocks + self.example // BLOCK
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        self.run = np.append(starts, len(key))  # postings of one term in one block
        self.run_block = key[starts] % self.blocks
        self.peak = np.maximum.reduceat(self.weight, starts) if len(key) else np.zeros(0)
        self.of_term = np.searchsorted(key[starts] // self.blocks, np.arange(n_terms + 1))
        self.visited = 0  # blocks scored so far

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query (terms, weights): vectors and scores, highest first, ties to the lesser rank; only scores above 0."""
        wide = np.zeros((len(queries), self.matrix.shape[1]))
        for i, (terms, weight) in enumerate(queries):
            at = self.column[terms]
            wide[i, at[at >= 0]] = weight[at >= 0]
        base = (wide @ self.matrix.T).reshape(len(queries), self.blocks, BLOCK)
        return [self._nearest(t, w, base[i], top, k) for i, ((t, w), top) in enumerate(zip(queries, base.max(axis=2)))]

    def _nearest(self, terms: np.ndarray, query: np.ndarray, base: np.ndarray, top: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        start, end = self.of_term[terms], self.of_term[terms + 1]
        runs, q = spans(start, end), np.repeat(query, end - start)
        block = self.run_block[runs]
        bound = np.bincount(block, self.peak[runs] * q, self.blocks) + top
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, scores, done, step = np.zeros(0, dtype=np.int64), np.zeros(0), 0, 8
        inside = np.arange(BLOCK)
        while done < len(order):
            now = order[done : done + step]
            if len(best) == k:
                now = now[bound[now] >= scores[-1] - 1e-9]
                if not len(now):
                    break
            chosen = np.zeros(self.blocks, dtype=bool)
            chosen[now] = True
            hit = np.flatnonzero(chosen[block])
            first, last = self.run[runs[hit]], self.run[runs[hit] + 1]
            at = spans(first, last)
            rest = np.bincount(self.example[at], self.weight[at] * np.repeat(q[hit], last - first), self.blocks * BLOCK)
            total = (base[now] + rest.reshape(self.blocks, BLOCK)[now]).ravel()
            found = np.flatnonzero(total > (scores[-1] - 1e-9 if len(best) == k else 0))
            best, scores = np.append(best, (now[:, None] * BLOCK + inside).ravel()[found]), np.append(scores, np.round(total[found], 12))
            if len(best) > 4 * k:  # all that may tie with the k-th stay
                keep = scores >= np.partition(scores, -k)[-k]
                best, scores = best[keep], scores[keep]
            first_k = np.lexsort((self.rank[best], -scores))[:k]
            best, scores = best[first_k], scores[first_k]
            done, step = done + len(now), 4 * step
            self.visited += len(now)
        return best, scores


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: mean x and value of each pool of the weighted isotonic fit of y on x."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        pools.append([a * c, a, b * c, c])
        while len(pools) > 1 and (pools[-2][1] == a or pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]):
            hi = pools.pop()
            lo = pools[-1]
            lo[0], lo[1], lo[2], lo[3] = lo[0] + hi[0], hi[1], lo[2] + hi[2], lo[3] + hi[3]
    return np.array([p[0] / p[3] for p in pools]), np.array([p[2] / p[3] for p in pools])


def grouped(ptr: np.ndarray, terms: np.ndarray, weights: np.ndarray, size: int = BLOCK, dim: int = 128) -> np.ndarray:
    """An order of the vectors in which like ones stand together: halves along the principal direction of hashed vectors."""
    n = len(ptr) - 1
    spread = (terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    x = np.zeros((n, dim))
    np.add.at(x, (np.repeat(np.arange(n), np.diff(ptr)), (spread % np.uint64(dim)).astype(np.int64)), weights * np.where(spread & np.uint64(1 << 20), 1.0, -1.0))
    out, todo = [], [np.arange(n)]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        c = x[rows] - x[rows].mean(axis=0)
        cov, v = c.T @ c, np.ones(dim)
        for _ in range(20):
            v = cov @ v + 1e-12
            v /= np.linalg.norm(v)
        rows = rows[np.argsort(c @ v, kind="stable")]
        half = -(-len(rows) // (2 * size)) * size
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.arange(0)


class Model:
    """Examples (id, label, terms and their counts) over terms with idf, a factor for each term, and what makes votes scores."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray, deciding: list[str], examples: list[tuple[int | None, int, np.ndarray, np.ndarray]], weights: tuple[float, float], k: int = 15, floor: float = 0.01, none_rate: float = 0.0):
        self.hashes, self.idf, self.deciding, self.weights, self.k, self.floor, self.none_rate = hashes, idf, deciding, weights, k, floor, none_rate
        self.knots: tuple | None = None
        self._vectors(examples)
        order = grouped(self.ptr, self.terms, self.weight)
        self._vectors([examples[e] for e in order])

    def _vectors(self, examples: list) -> None:
        self._names()
        vectors = [self.vector(t, n) for _, _, t, n in examples]
        self.ids, self.labels = [e[0] for e in examples], np.array([e[1] for e in examples], dtype=np.int64)
        self.ptr = np.append(0, np.cumsum([len(t) for t, _ in vectors])).astype(np.int64)
        self.terms = np.concatenate([t for t, _ in vectors] or [np.zeros(0)]).astype(np.int32)
        self.weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])

    def _names(self) -> None:
        self.finder = Finder(self.hashes, self.deciding)
        self.name_of = {t: name for name, t in zip(self.deciding, self.finder.number(self.deciding))}
        self.factor = np.full(len(self.hashes), self.floor)
        self.factor[list(self.name_of)] = 1.0

    @cached_property
    def index(self) -> BlockMaxIndex:
        """Built where it is used: in the workers."""
        rank = np.empty(len(self.ids), dtype=np.int64)
        rank[np.lexsort((self.labels, np.array(self.ids, dtype=np.int64)))] = np.arange(len(self.ids))
        return BlockMaxIndex(self.ptr, self.terms, self.weight, len(self.hashes), rank)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms] * self.factor[terms]
        return terms, w / (math.sqrt((w * w).sum()) or 1.0)

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], left_out: list[int] | None = None) -> list[tuple[float | None, np.ndarray]]:
        """For each query the share of label 1 in its neighbours' votes (None without any) and the neighbours."""
        out = []
        for i, (near, score) in enumerate(self.index.nearest(queries, self.k + (left_out is not None))):
            if left_out is not None:
                keep = near != left_out[i]
                near, score = near[keep][: self.k], score[keep][: self.k]
            y = self.labels[near]
            s = score * score * np.where(y == 1, *reversed(self.weights))
            out.append((float(s[y == 1].sum() / s.sum()) if len(near) else None, near))
        return out

    def left_out(self, examples: list[int]) -> list[float | None]:
        """The vote on each of these examples by all others."""
        at = [slice(self.ptr[e], self.ptr[e + 1]) for e in examples]
        return [v for k in range(0, len(at), BATCH) for v, _ in self.votes([(self.terms[x], self.weight[x]) for x in at[k : k + BATCH]], examples[k : k + BATCH])]

    def calibrate(self, votes: list[float | None]) -> None:
        """votes: of each example by the others."""
        have = np.array([v is not None for v in votes], dtype=bool)
        if have.any():
            y = self.labels[have]
            self.knots = monotone(np.array([v for v in votes if v is not None]), y.astype(float), np.where(y == 1, *reversed(self.weights)))

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int | None], list[str]]]:
        """Of each text the probability of label 1, ids of the nearest examples, the deciding terms found."""
        out = []
        for k in range(0, len(texts), BATCH):
            found = [self.finder.find(t) for t in texts[k : k + BATCH]]
            for (terms, _), (share, near) in zip(found, self.votes([self.vector(*f) for f in found])):
                p = self.none_rate if share is None else share if self.knots is None else float(np.interp(share, *self.knots))
                out.append((min(1.0, max(0.0, p)), [self.ids[e] for e in near], [self.name_of[t] for t in terms[self.factor[terms] == 1.0].tolist()]))
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("finder", "name_of", "factor", "index")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._names()


def _bags(drawn: DataFrame) -> DataFrame:
    """A row for each term of an example: doc_id, y, term, and n, how often a word occurs (0: a stem or level). One with no name for each example."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for d, y, t in zip(*(batch[c].to_pylist() for c in ("doc_id", "_y", "text"))):
                counts = Counter(letter_words(t))
                names = ["", *terms_of(counts)]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(names), pa.int64()), pa.array([y] * len(names), pa.int32()), pa.array(names), pa.array([counts.get(x, 0) for x in names], pa.int64())], ["doc_id", "y", "term", "n"])

    return drawn.select("doc_id", "_y", "text").mapInArrow(run, "doc_id long, y int, term string, n long")


def _deciding(seen: DataFrame, n1: int, n0: int, n_terms: int) -> list[str]:
    """Terms that depend on the label: their number is bounded by the sample's."""
    total = float(n1 + n0)

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    a, b = F.col("a"), F.col("b")
    has, lacks = a + b, F.lit(total) - a - b
    g2 = 2 * (part(a, has * n1 / total) + part(b, has * n0 / total) + part(n1 - a, lacks * n1 / total) + part(n0 - b, lacks * n0 / total)) if n1 and n0 else F.lit(0.0)
    return sorted(r.term for r in seen.where("term <> ''").where(g2 >= 2 * math.log(max(1, n_terms) / 0.01)).select("term").collect())


def document_frequencies(docs: DataFrame, finder: Finder) -> tuple[int, np.ndarray]:
    """Number of rows and, for each term, of rows that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast((finder.hashes, finder.deciding))

    def run(batches):
        import pyarrow as pa

        fresh_worker()
        hashes, deciding = shared.value
        f = Finder(hashes, deciding)
        rows, n = 0, np.zeros(len(hashes), dtype=np.int64)
        for batch in small(batches):
            for t in batch["text"].to_pylist():
                n[f.find(t)[0]] += 1
            rows += batch.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at), pa.int32()), pa.array(np.append(rows, n[at]), pa.int64())], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    at, n = got["term"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(len(finder.hashes), dtype=np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = 2000, k: int = 15, floor: float = 0.01) -> Model:
    """Learns from rows of docs whose doc_id has a label (0 or 1; the larger, if several) and for which learn holds.

    per_class: most distinct texts of each label that become examples. floor: factor of words that
    don't depend on the label. Null texts count as empty; copies are one example; without any label
    the model scores 0.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_m")).agg(F.max(label).cast("int").alias("_y"))
    rows = hashed(docs.where(learn)).select("doc_id", "_h")  # ids and hashes only: no text is shuffled
    drawn, totals = sample_texts(docs, rows.join(marks, F.col("doc_id") == F.col("_m")).select("_y", "doc_id", "_h"), "_y", per_class, "example")
    bag = written(_bags(drawn), "bags")
    seen = written(bag.groupBy("term").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")), "terms")
    each = seen.where("term = ''").first()  # every example has it once
    if each is None:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), [], [], (1.0, 1.0), k, floor)
    n1, n0 = each.a, each.b
    deciding = _deciding(seen, n1, n0, seen.count() - 1)

    # the examples' words and deciding terms, as hashes: at most 2 * per_class texts' words, as the sample bounds them
    kept = bag.where((F.col("n") > 0) | (F.col("term") == "") | F.col("term").isin(deciding))
    kept = kept.select("doc_id", "y", F.when(F.col("term") != "", F.xxhash64("term")).alias("h"), F.col("n").cast("int").alias("n")).toArrow()
    ids, ys, counts, named = kept["doc_id"].to_numpy(), kept["y"].to_numpy(), kept["n"].to_numpy(), kept["h"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    hashes, number = np.unique(kept["h"].combine_chunks().fill_null(0).to_numpy().view(np.uint64), return_inverse=True)
    hashes, number = (hashes, number) if (named & (number == 0)).any() else (hashes[1:], number - 1)  # nulls were 0, the least
    order = np.lexsort((number, ids))
    ids, ys, counts, named, number = (x[order] for x in (ids, ys, counts, named, number.astype(np.int32)))
    del kept, order
    finder = Finder(hashes, deciding)
    n_docs, df = document_frequencies(docs, finder)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    examples = []
    cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    for s, e in zip(cuts, np.append(cuts[1:], len(ids))):
        has = np.flatnonzero(named[s:e]) + s
        examples.append((int(ids[s]), int(ys[s]), number[has], np.maximum(1, counts[has])))
    del ids, ys, counts, named, number
    n_rows = {r._y: r.n for r in totals.collect()}
    weights = (n_rows.get(0, 0) / max(1, n0), n_rows.get(1, 0) / max(1, n1))
    bare = [weights[c] * sum(1 for _, y, t, _ in examples if y == c and not len(t)) for c in (0, 1)]
    model = Model(hashes, idf, deciding, examples, weights, k, floor, none_rate=(bare[1] + 0.01) / (sum(bare) + 1.0))
    for t in (bag, seen):
        forget(t)

    shared = spark.sparkContext.broadcast(model)

    def votes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(shared.value.left_out(batch["id"].to_pylist()), pa.float64())], ["id", "vote"])

    got = spark.range(0, len(examples), 1, max(1, -(-len(examples) // 250))).mapInArrow(votes, "id long, vote double").collect()
    shared.destroy()
    model.calibrate([r.vote for r in sorted(got, key=lambda r: r.id)])
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Adds toxic_score, toxic_examples (ids of the nearest, best first) and toxic_terms (in place of columns of these names) to any table with text.

    A null or empty text has no term. Other columns pass through; repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxic_score", "toxic_examples", "toxic_terms")
    kept = docs.columns

    def run(batches):
        import pyarrow as pa

        fresh_worker()
        m = shared.value
        for batch in small(batches):
            got = m.scores(batch["text"].to_pylist())
            new = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), *new], [*kept, "toxic_score", "toxic_examples", "toxic_terms"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", toxic_score double, toxic_examples array<long>, toxic_terms array<string>"
    return docs.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from labels of those whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    got = score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return got.select("doc_id", "held_out", F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_examples").alias("examples"), F.col("toxic_terms").alias("terms"))
