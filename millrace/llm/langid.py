"""Operator 10, language identification by averaged hashed subword embeddings.

A word is a run of letters, lower-cased; its subwords are its character n-grams with boundary
marks, and itself, hashed into buckets. A text is the mean of the embeddings of all its subwords,
a linear softmax gives the languages, and stochastic gradient descent in numpy trains both, with
snippets of 1 to max_words words of a bounded sample of labelled rows, so that short texts are
learned as well as long ones. A temperature and a rejection threshold are then set on documents
that weren't trained on.

As the mean and the softmax's input are linear, a word adds a fixed vector to its text's logits;
words' vectors are cached, so whole texts of any length cost one lookup a word.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fold, fresh_worker, give_back, sample_texts, small, table
from millrace.llm.words import letter_words

CACHE = 300_000


def subwords(word: str, buckets: int, low: int = 2, high: int = 5) -> list[int]:
    """Buckets of the n-grams of a word's bytes, with boundary marks, and of the whole word."""
    marked = b"<" + word.encode() + b">"
    crc, n = zlib.crc32, len(marked)
    return [crc(marked[k : k + g]) % buckets for g in range(low, high + 1) for k in range(n - g + 1)] + [crc(marked) % buckets]


@dataclass
class Model:
    """langs, emb (buckets x dim), out (dim x langs), bias; temperature and the confidence below which a text is rejected."""

    langs: list[str]
    emb: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def __post_init__(self):
        self.logits = (self.emb @ self.out).astype(np.float32)
        self._word: dict[str, int] = {}
        self._clear()

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("langs", "emb", "out", "bias", "temperature", "reject_below")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _clear(self) -> None:
        self._word.clear()
        self._sums, self._n = np.zeros((1024, len(self.langs) + 1)), 1  # row 0: nothing

    def _learn(self, words: list[str]) -> None:
        """Sums up the logits of new words, all at once."""
        ids = [subwords(w, len(self.emb)) for w in words]
        n = np.array([len(x) for x in ids])
        sums = np.add.reduceat(self.logits[np.concatenate([np.array(x) for x in ids])], np.append(0, np.cumsum(n)[:-1]), axis=0, dtype=np.float64)
        while self._n + len(words) > len(self._sums):
            self._sums = np.vstack([self._sums, np.zeros_like(self._sums)])
        self._sums[self._n : self._n + len(words)] = np.column_stack([sums, n])
        self._word.update(zip(words, range(self._n, self._n + len(words))))
        self._n += len(words)

    def totals(self, text: str) -> np.ndarray:
        """Sum of the logits of all subwords, and their number."""
        if self._n > CACHE:
            self._clear()
        known, words = self._word, letter_words(text)
        try:
            at = [known[w] for w in words]
        except KeyError:
            self._learn(list({w for w in words if w not in known}))
            at = [known[w] for w in words]
        return self._sums[at].sum(axis=0)

    def probabilities(self, text: str | None) -> np.ndarray | None:
        """Of the languages; None if the text has no letter."""
        total = self.totals(text) if text and self.langs else np.zeros(1)
        if not total[-1]:
            return None
        z = (total[:-1] / total[-1] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def snippets(docs: DataFrame, learn, per_lang: int = 1000, per_doc: int = 3, max_words: int = 30, seed: int = 0) -> DataFrame:
    """lang, doc (a hash), snippet: word windows of a sample of labelled rows.

    learn: which rows may be learned from. per_lang: most distinct texts of a language that are
    drawn. per_doc, max_words: how many windows are cut from anywhere in the whole text, and how long
    they are at most; the first is of three words at most, so that short texts are learned too.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"))
    drawn, _ = sample_texts(docs, rows, "lang", per_lang, f"snippets {seed}")
    drawn = drawn.withColumn("_h", F.xxhash64(F.lit(seed), "_h", "lang"))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for lang, text, h in zip(*(batch[c].to_pylist() for c in ("lang", "text", "_h"))):
                words = letter_words(text)
                rng = np.random.default_rng(h % 2**63)
                for k in range(per_doc if words else 0):
                    n = int(rng.integers(1, 4)) if k == 0 else int(rng.integers(1, max_words + 1))
                    at = int(rng.integers(0, max(1, len(words) - n + 1)))
                    out.append((lang, h, " ".join(words[at : at + n])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["lang", "doc", "snippet"])

    return drawn.select("lang", "text", "_h").mapInArrow(cut, "lang string, doc long, snippet string")


def train(rows: list[tuple[str, int, str]], buckets: int = 1 << 15, dim: int = 16, epochs: int = 4, rate: float = 0.5, batch: int = 64, keep: float = 0.9995, seed: int = 0) -> Model:
    """rows: (lang, document, snippet). A fifth of the documents calibrates: temperature by log loss, rejection so that `keep` of its snippets stay."""
    rows = sorted(rows)
    langs = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.1, (buckets, dim)), np.zeros((dim, len(langs))), np.zeros(len(langs))
    if len(langs) < 2:
        return Model(langs, emb, out, bias)
    known = {w: np.array(subwords(w, buckets), dtype=np.int32) for w in {w for _, _, s in rows for w in s.split()}}
    data = [(np.concatenate([known[w] for w in s.split()]), langs.index(lang)) for lang, _, s in rows]
    held = np.array([doc % 5 == 0 for _, doc, _ in rows])
    weight = len(rows) / (len(langs) * np.bincount([y for _, y in data], minlength=len(langs)))  # languages count alike
    order, steps = np.flatnonzero(~held), 0
    total = max(1, epochs * -(-len(order) // batch))
    for _ in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), batch):
            part = [data[i] for i in order[k : k + batch]]
            ids = np.concatenate([x for x, _ in part])
            n = np.array([len(x) for x, _ in part])
            of = np.repeat(np.arange(len(part)), n)
            mean = np.add.reduceat(emb[ids], np.append(0, np.cumsum(n)[:-1])) / n[:, None]
            y = np.array([y for _, y in part])
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None]
            now = rate * (1 - steps / total)
            back = (p @ out.T) / n[:, None]
            out -= now * (mean.T @ p) / len(part) * 8
            bias -= now * p.mean(axis=0)
            np.subtract.at(emb, ids, now * back[of])
            steps += 1
    model = Model(langs, emb.astype(np.float32), out.astype(np.float32), bias)
    check = [(model.totals(rows[i][2]), data[i][1]) for i in np.flatnonzero(held)]
    if check:
        z = np.array([t[:-1] / t[-1] + bias for t, _ in check])
        y = np.array([y for _, y in check])

        def soft(t):
            e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        grid = np.geomspace(0.1, 10, 41)
        model.temperature = float(min(grid, key=lambda t: -np.log(soft(t)[np.arange(len(y)), y] + 1e-12).mean()))
        model.reject_below = float(np.quantile(soft(model.temperature).max(axis=1), 1 - keep))
    return model


def fit(docs: DataFrame, learn, **options) -> Model:
    """Trains on snippets(docs, learn, **options); no labelled row, or one language only, gives a model that knows what there is.

    What reaches the driver is at most per_lang * per_doc windows of each language.
    """
    model = train([(r.lang, r.doc, r.snippet) for r in snippets(docs, learn, **options).collect()])
    give_back()
    return model


def identify(docs: DataFrame, model: Model, unknown: str = "und") -> DataFrame:
    """Adds lang_pred, lang_score and lang_rejected (in place of columns of these names) to any table with text; other columns pass through.

    A null text, or one without a letter, is `unknown`, with score 0, and rejected. Others get the
    likeliest language and its calibrated probability, and are rejected below the model's threshold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        fresh_worker()
        m = shared.value
        for batch in small(batches):
            preds, scores, out = [], [], []
            for text in batch["text"].to_pylist():
                p = m.probabilities(text)
                best = int(np.argmax(p)) if p is not None else -1
                preds.append(unknown if p is None else m.langs[best])
                scores.append(0.0 if p is None else float(p[best]))
                out.append(p is None or float(p[best]) < m.reject_below)
            new = [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), *new], [*kept, "lang_pred", "lang_score", "lang_rejected"])

    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    kept = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, lang_score double, lang_rejected boolean"
    return docs.mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = fit(docs, ~held_out)
    got = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return got.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
