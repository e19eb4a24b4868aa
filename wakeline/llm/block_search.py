"""Nearest vectors by a block matrix join over int8 tiles, exact after recomputation.

Method. Vectors are scaled to length one and rounded to int8 with a scale and a rounding error of their own. Queries
and candidates are dealt into blocks by hash; every query block meets every candidate block in one tile. There the
integer product gives all cosines at once, each with a bound from the two rounding errors. Only pairs whose upper bound
reaches the query's current k-th best are recomputed in double precision on the original vectors and pushed to the
query's heap of ``k``. The heaps of all tiles are merged per query by Spark's rank limit, which cuts every task's rows
to ``k`` per query before the shuffle. The result is exact, recall is 1.

Scale. A tile is bounded by the two block sizes, however large the table; a row travels once per block of the other
side. No row is a hot key, since blocks are hashes of distinct ids.

Defined cases: vectors that are null, zero, or hold null or non-finite numbers take no part, neither do rows without
id; rows repeated under one id count once, with the least vector; only vectors of equal length are compared; ties go
to the smaller id; fewer candidates than ``k`` are all returned; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Candidates multiplied at a time inside a tile.
STRIP = 512
#: Covers the rounding of the bound itself.
SLACK = 1e-6


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """vec_id, v, dim: the vectors that take part, once per id."""
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False)))
    clean = vectors.select("vec_id", F.col(vector).cast("array<double>").alias("v"))
    clean = clean.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & some)
    once = clean.groupBy("vec_id").agg(F.min("v").alias("v"))
    return once.withColumn("dim", F.size("v"))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from left to right."""
    def total(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1]

    return total(a * b) / np.sqrt(total(a * a) * total(b * b))


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the lengths of what they stand for and of what they leave out."""
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127.0
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    stood = whole * scale[:, None]
    rest = np.sqrt(((unit - stood) ** 2).sum(axis=1))
    return whole, scale, np.sqrt((stood * stood).sum(axis=1)), rest


def tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best candidates of each query within one tile."""
    candidates = candidates.sort_values("vec_id")
    q, q_ids = np.stack(queries["v"]).astype(np.float64), queries["vec_id"].to_numpy()
    c, c_ids = np.stack(candidates["v"]).astype(np.float64), candidates["vec_id"].to_numpy()
    q8, q_scale, _, q_rest = quantised(q)
    c8, c_scale, c_long, c_rest = quantised(c)
    # float arithmetic on these integers is exact up to the width of its mantissa
    exact = np.float32 if q.shape[1] * 127 * 127 < 2**24 else np.float64
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    bar = np.full(len(q_ids), -np.inf)
    for at in range(0, len(c_ids), STRIP):
        some = slice(at, at + STRIP)
        near = (q8.astype(exact) @ c8[some].astype(exact).T).astype(np.float64) * (q_scale[:, None] * c_scale[some])
        error = q_rest[:, None] * c_long[some] + c_rest[some] + SLACK
        own = q_ids[:, None] == c_ids[some]
        if near.shape[1] > k:
            sure = np.where(own, -np.inf, near - error)
            bar = np.maximum(bar, -np.partition(-sure, k - 1, axis=1)[:, k - 1])
        rows, columns = np.nonzero((near + error >= bar[:, None]) & ~own)
        for i, j, score in zip(rows, columns + at, cosine(q[rows], c[columns + at]) if len(rows) else ()):
            entry = (score, -c_ids[j])
            if len(heaps[i]) < k:
                heapq.heappush(heaps[i], entry)
            else:
                heapq.heappushpop(heaps[i], entry)
        full = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        bar = np.maximum(bar, full)
    out = [(q_ids[i], -minus, score) for i, h in enumerate(heaps) for score, minus in h]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest cosines of every query among all other rows.

    ``is_query`` is a condition on ``vec_id``.
    """
    found = usable(vectors, vector)
    sizes = found.agg(F.count("*"), F.count_if(is_query)).first()
    c_blocks, q_blocks = max(1, math.ceil(sizes[0] / CANDIDATE_BLOCK)), max(1, math.ceil(sizes[1] / QUERY_BLOCK))

    def dealt(rows: DataFrame, mine: str, blocks: int, other: str, others: int) -> DataFrame:
        home = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias(mine)
        return rows.select("vec_id", "v", "dim", home, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    queries = dealt(found.where(is_query), "qb", q_blocks, "cb", c_blocks)
    candidates = dealt(found, "cb", c_blocks, "qb", q_blocks)
    kind = "query_id long, vec_id long, score double"
    none = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
    keys = ["dim", "qb", "cb"]
    best = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(
        lambda a, b: tile(a, b, k) if len(a) and len(b) else none, kind
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, every: int = 50) -> str:
    """The same rows from DuckDB by comparing every query with every row."""
    return f"""
        WITH v AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                   GROUP BY vec_id),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
              FROM v q, v c WHERE q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
