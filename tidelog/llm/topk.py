"""Exact top-k search by inner product with a pivot table.

Vectors are scaled to integers. Distances to pivots are computed once for every vector and kept beside it. For a
query q and a vector x the triangle inequality gives d(q, x) >= max over pivots |d(q, p) - d(x, p)|, and since
2 q.x = |q|^2 + |x|^2 - d(q, x)^2 the largest lower bound on the distance is a least upper bound on the score.
Candidates are evaluated in the order of that bound, and a query stops once the next bound lies below its
k-th best score, so the result is exact.

Queries and vectors meet in blocks: each pair of a query block and a vector block is one group of
bounded size, whatever the number of vectors, and gives k rows per query, which are then ranked per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import staged

SCALE = 1024
PIVOTS = 32
QUERY_BLOCK = 1024
VECTOR_BLOCK = 16384
#: Candidates evaluated together before a query looks at its stopping rule again.
STEP = 256


def scaled(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """Usable vectors as integers: (id, v, dim), one row per id and vector."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(usable).select(
        F.col(id_col).cast("bigint").alias("id"), whole.alias("v"), F.size(v).alias("dim")
    ).distinct()


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), dim)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of each row of a with b. Whole numbers below 2^53 are exact in floating point, larger
    ones take Python's integers, held within the range of a long."""
    most = float(np.abs(a).astype(float).max(initial=0)) * float(np.abs(b).astype(float).max(initial=0)) * max(1, b.shape[-1])
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.astype(object)
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact], dtype=np.int64)


def search_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best vectors of a block for each query of a block."""
    if queries.empty or vectors.empty:
        return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")
    dim = int(queries["dim"].iloc[0])
    ids, x, q = vectors["id"].to_numpy(), matrix(vectors["v"], dim), matrix(queries["v"], dim)
    far_x = np.array(vectors["far"].tolist(), dtype=np.float64).reshape(len(ids), -1)
    far_q = np.array(queries["far"].tolist(), dtype=np.float64).reshape(len(q), -1)
    norm_x, norm_q = (x.astype(float) ** 2).sum(1), (q.astype(float) ** 2).sum(1)
    out = []
    for query, own, own_far, own_norm in zip(queries["id"], q, far_q, norm_q, strict=True):
        lower = np.zeros(len(ids))
        for p in range(far_x.shape[1]):
            np.maximum(lower, np.abs(far_x[:, p] - own_far[p]), out=lower)
        # Bounds are in floating point: the slack covers rounding in distances and squares.
        slack = 1 + 1e-9 * (own_norm + norm_x)
        lower = np.maximum(lower - 1e-9 * (np.sqrt(own_norm) + np.sqrt(norm_x)) - 1e-6, 0)
        upper = (own_norm + norm_x - lower * lower) / 2 + slack
        order = np.argsort(-upper, kind="stable")
        order = order[ids[order] != query]
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(order), STEP):
            if len(best) == k and upper[order[at]] < best[-1]:
                break
            some = order[at : at + STEP]
            best_ids, best = np.concatenate((best_ids, ids[some])), np.concatenate((best, products(x[some], own)))
            top = np.lexsort((best_ids, -best.astype(object) if best.min() == -(2**63) else -best))[:k]
            best_ids, best = best_ids[top], best[top]
        out.append(pd.DataFrame({"query_id": query, "id": best_ids, "score": best}))
    return pd.concat(out, ignore_index=True).astype("int64")


def with_pivots(vectors: DataFrame, pivots: int) -> DataFrame:
    """Vectors with their distances to pivots. The pivots of each dimension are the vectors with the
    smallest hashes of their content: a choice that is the same in every run, of bounded size."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("v"), "v", "id")
    chosen = vectors.withColumn("n", F.row_number().over(order)).where(F.col("n") <= pivots)
    table: dict[int, list] = {}
    for row in chosen.select("dim", "v").collect():
        table.setdefault(row.dim, []).append(row.v)

    def measure(batches):
        for pdf in batches:
            far = pd.Series([None] * len(pdf), dtype=object)
            for dim, rows in pdf.reset_index(drop=True).groupby("dim").groups.items():
                far.loc[rows] = list(distances(matrix(pdf["v"].iloc[rows], dim), np.array(table[dim], np.int64).reshape(-1, dim)))
            yield pdf.assign(far=far.to_numpy())

    return vectors.mapInPandas(measure, "id bigint, v array<bigint>, dim int, far array<double>")


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 10, scale: int = SCALE, pivots: int = PIVOTS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query, ties to the smaller id.

    A component x becomes floor(scale * x). Vectors that are null or hold a null or non-finite component, and rows
    without id, take no part; a query meets vectors of its own dimension only. Repeated rows count once;
    a query's own row is every row with its id. Fewer than k candidates are all returned, no candidates give no
    rows. Scores beyond the range of a long are held at its ends.
    """
    table = staged(with_pivots(scaled(vectors, scale, id_col, vector_col), pivots), "pivots")
    asked = scaled(queries, scale, id_col, vector_col).join(table, ["id", "v", "dim"])
    count = table.count()
    n_vectors, n_queries = 1 + count // VECTOR_BLOCK, 1 + asked.count() // QUERY_BLOCK
    own = lambda n, *seed: F.pmod(F.xxhash64("id", "v", *seed), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", own(n_queries)).withColumn("vb", every(n_vectors))
    again = table.select(*[F.col(c).alias(c) for c in table.columns])  # its own columns beside those of `left`
    right = again.withColumn("vb", own(n_vectors, F.lit(1))).withColumn("qb", every(n_queries))
    keys = ["dim", "qb", "vb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda q, v: search_block(q, v, k), "query_id bigint, id bigint, score bigint"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = near.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score"
    )
