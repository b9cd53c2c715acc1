"""Operator 4, embedding near-duplicates by lattice hashing.

A unit vector is projected at random to 16 numbers, and each half is decoded to the nearest point
of the lattice E8; the pair of points, in one of several tables, is its cell. Vectors at a small
angle tend to share a cell. A vector is stored under its own cell and probes, besides, the cells
where one half is replaced by one of its next nearest lattice points. What meets in a cell is
verified by its cosine.

Exact copies are one vector with a weight before anything meets. Small cells give candidate pairs.
A cell of more than MOST vectors is cut into chunks, chunk meets chunk in a matrix product, and
only a spanning forest of the links found leaves the task, not the pairs. The forest's components
are all that can link; inside each, chunk by chunk, every cosine is taken once, so that the counts
of links are whole and each pair counts once, whatever the number of cells that it shares.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, written
from millrace.llm.graph import connected_components

MOST, CHUNK = 64, 1024


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, from their rule: two entries of +-1, or all of +-1/2 with an even number of minus signs."""
    pairs = np.zeros((112, 8))
    for k, ((i, j), (a, b)) in enumerate(product(combinations(range(8), 2), product((1, -1), repeat=2))):
        pairs[k, i], pairs[k, j] = a, b
    halves = np.array([s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.vstack([pairs, halves])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: whole coordinates of even sum, or all shifted by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(closer[:, None], b, a)


class Lattice:
    """cells(unit vectors): for each table, codes of the own cell (column 0) and of the probes."""

    def __init__(self, dim: int, tables: int = 10, scale: float = 0.8, probes: int = 4, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(tables, 2, dim, 8)) * scale
        self.mix = rng.integers(1, 2**63, size=(2, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.near, self.probes = minimal_vectors(), probes

    def _code(self, half: int, points: np.ndarray) -> np.ndarray:
        return (np.rint(2 * points).astype(np.int64).astype(np.uint64) * self.mix[half]).sum(axis=-1, dtype=np.uint64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        out = []
        for planes in self.planes:
            own, others = [], []
            for half in range(2):
                x = unit @ planes[half]
                point = decode_e8(x)
                away = -2 * (x - point) @ self.near.T + (self.near**2).sum(axis=1)
                best = np.argpartition(away, self.probes, axis=1)[:, : self.probes]
                own.append(self._code(half, point))
                others.append(self._code(half, point[:, None, :] + self.near[best]))
            with np.errstate(over="ignore"):
                turn = np.uint64(0x9E3779B97F4A7C15)
                codes = [(own[0] * turn) ^ own[1], *((others[0] * turn) ^ own[1][:, None]).T, *((own[0] * turn)[:, None] ^ others[1]).T]
            out.append(np.stack(codes, axis=1).view(np.int64))
        return np.stack(out, axis=1)


def _unit(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square under- or overflows
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _forest(a, b, cosine: float):
    """Edges (a, b) of a spanning forest of the links between two chunks (nodes, unit vectors), by breadth-first search over the matrix."""
    (na, va), (nb, vb) = a, b
    link = va @ vb.T >= cosine
    left_a, left_b, out = link.any(axis=1), link.any(axis=0), []
    for start in range(len(na)):
        if not left_a[start]:
            continue
        left_a[start], front_a = False, np.array([start])
        while len(front_a):
            new_b = np.flatnonzero(link[front_a].any(axis=0) & left_b)
            left_b[new_b] = False
            out += [(int(na[front_a[link[front_a, j].argmax()]]), int(nb[j])) for j in new_b]
            new_a = np.flatnonzero(link[:, new_b].any(axis=1) & left_a) if len(new_b) else np.empty(0, dtype=int)
            left_a[new_a] = False
            out += [(int(nb[new_b[link[i, new_b].argmax()]]), int(na[i])) for i in new_a]
            front_a = new_a
    return [(x, y) for x, y in out if x != y]


def _chunk_pairs(rows: DataFrame, keys: list[str], size: str, per: int = CHUNK) -> DataFrame:
    """Deals the members of each group into chunks of about per, one row for each pair of chunks a member is in: side 0 or 1, i <= j."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / per)).cast("int")
    dealt = rows.withColumn("_n", n).withColumn("_c", F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    both = dealt.withColumns({"i": F.least("_c", "_o"), "j": F.greatest("_c", "_o"), "side": F.when(F.col("_c") <= F.col("_o"), 0).otherwise(1)})
    return both.drop("_n", "_c", "_o")


def _sides(tab, *cols: str):
    side = tab["side"].to_numpy()
    first = {c: tab[c].to_numpy()[side == 0] for c in cols}
    units = _unit(tab["v"])
    if not (side == 1).any():
        return (first, units), (first, units), True
    return (first, units[side == 0]), ({c: tab[c].to_numpy()[side == 1] for c in cols}, units[side == 1]), False


def near_vectors(vectors: DataFrame, cosine: float = 0.98, tables: int = 10, scale: float = 0.8, probes: int = 4, seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of a table with vec_id, embedding, label.

    Only rows with the same label that isn't null meet, and vectors of the same length. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing; neither
    do rows without a label. Rows that repeat are vectors that link with each other.
    """
    real = F.col("embedding").cast("array<double>")
    sound = F.forall(real, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(real, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("ok", F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & sound, F.lit(False)))
    node = F.xxhash64("label", F.size("embedding"), "embedding")
    alike = written(rows.where("ok").groupBy("label", F.col("embedding").alias("v")).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")).withColumn("node", F.xxhash64("label", F.size("v"), "v")), "vectors")

    def hashed(batches):
        import pyarrow as pa

        made: dict[int, Lattice] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                sizes = np.diff(part["v"].offsets.to_numpy())
                nodes, groups = part["node"].to_numpy(), part["g"].to_numpy()
                for d in np.unique(sizes):
                    at = np.flatnonzero(sizes == d)
                    cells = made.setdefault(int(d), Lattice(int(d), tables, scale, probes, seed)).cells(_unit(part["v"].take(pa.array(at))))
                    n, t, p = cells.shape
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(nodes[at], t * p)), pa.array(np.repeat(groups[at], t * p)), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n)), pa.array(cells.reshape(-1)), pa.array(np.tile(np.arange(p) == 0, n * t))],
                        ["node", "g", "t", "cell", "own"],
                    )

    cells = alike.select("node", F.xxhash64("label", F.size("v")).alias("g"), "v").mapInArrow(hashed, "node long, g long, t int, cell long, own boolean")
    cells = written(cells, "cells")
    key = ["g", "t", "cell"]
    busy = cells.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("own").alias("n_own")).where("n > 1 and n_own > 0").drop("n_own")
    members = written(cells.join(busy, key), "members")

    small = members.where(F.col("n") <= MOST)
    pairs = small.where("own").alias("x").join(small.alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in key])
    pairs = pairs.where("x.node <> y.node").select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    of = alike.select("node", "v")
    pairs = pairs.join(of.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(of.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")

    def verified(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                sizes = np.diff(batch["va"].offsets.to_numpy())
                for d in np.unique(sizes):
                    part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                    good = (_unit(part["va"]) * _unit(part["vb"])).sum(axis=1) >= cosine
                    yield pa.RecordBatch.from_arrays([part["a"].filter(pa.array(good)), part["b"].filter(pa.array(good))], ["a", "b"])

    def crowd(tab):
        import pyarrow as pa

        (a, va), (b, vb), _ = _sides(tab, "node")
        out = _forest((a["node"], va), (b["node"], vb), cosine)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], []))], ["a", "b"])

    crowds = _chunk_pairs(members.where(F.col("n") > MOST).drop("own").join(of, "node"), key, "n")
    edges = pairs.select("a", "b", "va", "vb").mapInArrow(verified, "a long, b long").unionByName(crowds.groupBy(*key, "i", "j").applyInArrow(crowd, "a long, b long"))
    linked = written(connected_components(edges), "components")

    def count(tab):
        import pyarrow as pa

        (a, va), (b, vb), same = _sides(tab, "node", "weight")
        link = va @ vb.T >= cosine
        if same:
            np.fill_diagonal(link, False)
        got = [(a["node"], link @ b["weight"])] + ([] if same else [(b["node"], a["weight"] @ link)])
        return pa.Table.from_arrays([pa.array(np.concatenate([g[k] for g in got]).astype(np.int64)) for k in (0, 1)], ["node", "links"])

    inside = alike.select("node", "v", "weight").join(linked, "node")
    sizes = linked.groupBy("component").agg(F.count("*").alias("n"))
    counted = _chunk_pairs(inside.join(sizes, "component"), ["component"], "n").groupBy("component", "i", "j").applyInArrow(count, "node long, links long")
    counts = counted.groupBy("node").agg(F.sum("links").alias("links"))
    least = inside.join(alike.select("node", "vec_id"), "node").groupBy("component").agg(F.min("vec_id").alias("first"))
    names = linked.join(least, "component").select("node", "first")
    about = alike.select("node", "weight", "vec_id").join(counts, "node", "left").join(names, "node", "left")
    about = about.select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"))
    got = rows.where("ok").select("vec_id", node.alias("node")).join(about, "node").drop("node")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return got.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_lattice_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, links at a cosine of 0.98 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
