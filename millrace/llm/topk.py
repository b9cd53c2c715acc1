"""Operator 3, exact top-k inner products by the threshold algorithm.

Rows and queries are dealt into blocks; every block of rows meets every block of queries once. In
a block of rows there is one list for each dimension, sorted by its component. A query walks all
lists at once, each from the end that its own component favours, scores each row when it is first
seen, and stops when the sum of its components times the lists' current values can't reach the
k-th score any more. The depth doubles from step to step. The k best of every block are merged.

Only the stated queries meet all rows, so the work is queries times rows; a group holds one block
of each, whatever the size of the tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import table, written

ROW_BLOCK, QUERY_BLOCK = 65_536, 1024


def threshold_topk(ids: np.ndarray, rows: np.ndarray, orders: np.ndarray, query: np.ndarray, own: int, k: int, step: int = 64, most: int | None = None) -> list[tuple[int, int]]:
    """(score, id) of the k best of rows for query, ties to the smaller id; rows with the id `own` don't count.

    most: the largest score; one beyond counts as this one (below: -most - 1).
    rows: n x d whole numbers. orders: d x n, the ascending order of each column.
    """
    n, d = rows.shape
    dims = np.flatnonzero(query)
    k = min(k, int((ids != own).sum()))
    if not k:
        return []
    seen = np.zeros(n, dtype=bool)
    best_s, best_i = np.empty(0, dtype=rows.dtype), np.empty(0, dtype=np.int64)
    up = query[dims] > 0
    depth = 0
    while True:
        to = min(n, max(step, 2 * depth))
        fresh = np.zeros(n, dtype=bool)
        if len(dims):
            fresh[orders[dims[up], n - to : n - depth]] = True
            fresh[orders[dims[~up], depth:to]] = True
            fresh &= ~seen
        else:
            fresh[~seen] = True  # a zero query scores all rows alike
        seen |= fresh
        at = np.flatnonzero(fresh)
        score = rows[at] @ query
        if most is not None:
            score = np.clip(score, -most - 1, most)
        keep = ids[at] != own
        if len(best_s) == k:
            keep &= score >= best_s[-1]
        best_s, best_i = np.concatenate([best_s, score[keep]]), np.concatenate([best_i, ids[at][keep]])
        order = np.lexsort((best_i, -best_s))[:k]
        best_s, best_i, depth = best_s[order], best_i[order], to
        if depth == n or not len(dims) or seen.all():
            break
        if len(best_s) == k:
            edge = np.where(up, rows[orders[dims, n - depth], dims], rows[orders[dims, depth - 1], dims])
            if best_s[-1] > (query[dims] * edge).sum():  # no unseen row can reach the k-th, not even as a tie
                break
    return list(zip(best_s.tolist(), best_i.tolist()))


def _exact_kind(rows: np.ndarray, queries: np.ndarray) -> type:
    """The cheapest number type in which all inner products of whole numbers are exact."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _block(k: int):
    def run(left, right):
        import pyarrow as pa

        names = ["query_id", "vec_id", "score"]
        out = []
        if left.num_rows and right.num_rows:
            ids = left["vec_id"].to_numpy()
            rows = left["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            queries = right["v"].combine_chunks().flatten().to_numpy().reshape(right.num_rows, -1)
            kind = _exact_kind(rows, queries)
            orders = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)
            rows, queries = rows.astype(kind), queries.astype(kind)
            for own, q in zip(right["vec_id"].to_pylist(), queries):
                out += [(own, i, int(s)) for s, i in threshold_topk(ids, rows, orders, q, own, k, most=2**63 - 1 if kind is object else None)]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return run


def exact_topk(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every query; both have vec_id and v (array of whole numbers).

    A row with the query's id is no candidate. Rows with a null id take no part; rows that repeat
    an id are candidates each; of queries that repeat an id the least vector counts. Vectors meet
    only those of the same length. A score that a long can't hold is the nearest long. Empty tables give no rows.
    """
    rows = written(rows.where("vec_id is not null").withColumn("d", F.size("v")), "rows")
    queries = queries.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    queries = written(queries, "queries")
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    r = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(row_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    met = r.groupBy("d", "rb", "qb").cogroup(q.groupBy("d", "rb", "qb")).applyInArrow(_block(k), "query_id long, vec_id long, score long")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v = floor(scale * x) for each component x as double; without null or empty vectors and those with null, infinite or NaN components."""
    real = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.forall(real, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(real, lambda x: F.floor(x * scale)).alias("v"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every row whose vec_id is divisible by 50."""
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    return exact_topk(rows, rows.where("vec_id % 50 = 0"), 5)


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select q.vec_id as query_id, r.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v r on q.vec_id % 50 = 0 and q.vec_id <> r.vec_id
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
