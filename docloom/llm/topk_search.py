"""Exact top-k inner products by columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block and those that meet a strip together; components of a block of candidates and of a strip of it;
#: dimensions added at a time.
QUERIES, GROUP, COMPONENTS, STRIP, DIMENSIONS = 2048, 64, 1 << 20, 1 << 17, 8
#: Components beyond it count as it: past float's range products would be infinite.
LARGEST = 2.0**300
LONG = 1 << 63


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Vertical: a row for each dimension, floor(64 * x)."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((width, len(vectors)))
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return np.floor(np.clip(out, -LARGEST / 64, LARGEST / 64) * 64)


def _exact(query: np.ndarray, vectors: np.ndarray) -> list[int]:
    """Integer inner products without rounding, held to a long's range: floats where every partial sum fits 53 bits, else
    whole numbers of any size."""
    if np.sqrt((query * query).sum()) * np.sqrt((vectors * vectors).sum(0)).max(initial=0) < 2**53:
        return [int(s) for s in query @ vectors]
    whole = [int(x) for x in query]
    products = (sum(a * int(b) for a, b in zip(whole, column, strict=True)) for column in vectors.T)
    return [max(-LONG, min(LONG - 1, s)) for s in products]


class Best:
    """A query's k best so far, exact."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []  # (-score, id), best first

    def add(self, ids: np.ndarray, scores: list[int]) -> None:
        self.rows = sorted([*self.rows, *((-s, int(i)) for i, s in zip(ids, scores, strict=True))])[: self.k]

    def least(self) -> float:
        """The score to reach; none while there are fewer than k, or the k-th is the least there can be."""
        return float(-self.rows[-1][0]) if len(self.rows) == self.k and self.rows[-1][0] < LONG else -np.inf


def search_block(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, strip: int = 4096) -> tuple[list[Best], float]:
    """Each query's k best of the block, and the share of all products that was computed. own: ids of the queries, which
    are no candidates of themselves.

    queries and vectors are vertical. Dimensions come in the order of the mass they can add, and in blocks: after each
    one a candidate can gain no more than the product of what is left of both lengths, and those that can't reach the
    k-th best score go. While most are left, a block is added to all candidates of a strip at once; then
    the survivors' columns are compacted for each query and go on alone, fewer after every block. The most promising of
    the first strip are finished at once for a threshold; later strips start with the best threshold so far.
    """
    width = max(len(queries), len(vectors))
    queries = np.pad(queries, ((0, width - len(queries)), (0, 0)))
    vectors = np.pad(vectors, ((0, width - len(vectors)), (0, 0)))
    order = np.argsort(-np.sqrt((queries * queries).sum(1)) * np.sqrt((vectors * vectors).sum(1)), kind="stable")
    queries, vectors = queries[order], vectors[order]
    rest = lambda m: np.sqrt(np.vstack([np.cumsum((m * m)[::-1], axis=0)[::-1], np.zeros((1, m.shape[1]))]))
    best, done, n = [Best(k) for _ in own], 0, vectors.shape[1]
    for start in range(0, n, strip):
        x, names = vectors[:, start : start + strip], ids[start : start + strip]
        left = rest(x)
        for a in range(0, len(own), GROUP):
            q, mine = queries[:, a : a + GROUP], best[a : a + GROUP]
            more, itself = rest(q), own[a : a + GROUP, None] == names
            rounding = width * 2.0**-50 * more[0][:, None] * left[0]
            partial, alive, d = np.zeros((q.shape[1], x.shape[1])), ~itself, 0
            while d < width and alive.mean() > 0.2:
                end = min(width, d + DIMENSIONS)
                partial += q[d:end].T @ x[d:end]
                done += (end - d) * partial.size
                if d == 0 and len(mine[0].rows) < k:
                    for i, b in enumerate(mine):
                        at = np.argpartition(np.where(alive[i], -partial[i], np.inf), min(2 * k, x.shape[1] - 1))[: 2 * k]
                        at = at[alive[i, at]]
                        b.add(names[at], _exact(q[:, i], x[:, at]))
                        alive[i, at] = False
                        done += width * len(at)
                d = end
                if 4 * d >= width:
                    least = np.array([b.least() for b in mine])
                    alive &= partial + more[d][:, None] * left[d] + rounding >= least[:, None]
            for i, b in enumerate(mine):
                at, e = np.flatnonzero(alive[i]), d
                score = partial[i, at]
                while e < width and len(at):
                    end = min(width, e + DIMENSIONS)
                    score = score + q[e:end, i] @ x[e:end, at]
                    done += (end - e) * len(at)
                    e = end
                    keep = score + more[e, i] * left[e, at] + rounding[i, at] >= b.least()
                    at, score = at[keep], score[keep]
                if len(at):
                    b.add(names[at], _exact(q[:, i], x[:, at]))
    return best, done / max(1, width * n * len(own))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with the other vectors.

    Both have (vec_id, embedding). Components x become floor(64 * x). A query's own vec_id is no candidate; ties go
    to the smaller vec_id. Vectors that are null, or hold null or non-finite components, take no part, nor do rows
    without vec_id; a shorter vector counts as padded with zeros. Rows that repeat a vec_id are one vector, the
    smallest. Fewer than k candidates give fewer rows. Products are summed without rounding, however large; a score
    beyond a long's range counts as the long nearest to it, so such scores tie. Components beyond 2^300 count as
    2^300 (a float's never are).

    Blocks of queries meet blocks of candidates of bounded size, each pair in a task of its own. Its best k rows of
    every query are ranked per query; Spark cuts them to k in every task before they are shuffled, and sorts the rest
    on disk if need be.
    """

    def clean(df: DataFrame) -> DataFrame:
        x = F.col("embedding").cast("array<double>")
        bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return df.select(F.col("vec_id").cast("long"), x.alias("x")).where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)

    def unique(df: DataFrame) -> DataFrame:
        return df.groupBy("vec_id").agg(F.min("x").alias("x"))

    size = lambda df: df.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    (nq, qw), (nv, vw) = size(queries), size(vectors)
    each = max(256, COMPONENTS // max(1, qw, vw))
    strip = max(64, STRIP // max(1, qw, vw))
    q, v = unique(clean(queries)), unique(clean(vectors))
    q_blocks, v_blocks = max(1, -(-nq // QUERIES)), max(1, -(-nv // each))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = q.select("vec_id", "x", block(q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("vb"))
    v = v.select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), block(v_blocks).alias("vb"))

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            own = left.vec_id.to_numpy()
            found, _ = search_block(_matrix(left.x), own, right.vec_id.to_numpy(), _matrix(right.x), k, strip)
            rows = [(q, i, -s) for q, b in zip(own, found, strict=True) for s, i in b.rows]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")

    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(tile, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
