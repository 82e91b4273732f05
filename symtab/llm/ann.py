"""Approximate nearest neighbours by a permutation index (operator 2).

PIVOTS vectors, a bounded sample, are the reference points. A vector is represented by its PREFIX nearest pivots in order
and posted, with its ranks, in their inverted files. A query opens the files of its own PREFIX nearest pivots and adds up
what the postings tell of the footrule distance (how far the ranks of a pivot differ, PREFIX where a vector does not have it):
the distance is 2 * sum of all (PREFIX - rank) less twice the sum, over pivots that both have, of the lesser of
(PREFIX - rank), so postings alone give it. No other vector is looked at. The best SHARE of a block is reranked by
the exact inner product in double precision.

The index is dealt out by vectors: each block of about BLOCK vectors has inverted files of its own, the stated queries come
to every block in blocks, and each pair of blocks is one task that returns the few best of each query. The queries asked for
are a share of all vectors, and of vectors without clusters no index can leave out more than a share, so the
work grows with queries times vectors. Only pivots (at most PIVOTS vectors) pass through the driver. With ``share`` 1 and a
``prefix`` of PIVOTS every vector is reranked: the exact way.

Equal vectors are indexed once. A group of copies is known by the smallest of its ids, as many as a result can hold, which
Spark cuts down before the shuffle; a query that has copies is searched once.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id and vectors of
another length than most (the smallest such length in a tie). Equal scores go to the smaller id. Repeated rows count
once; no rows give no rows; only the id and vector columns are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symtab.llm.common import materialize

PIVOTS, PREFIX = 512, 32
#: Vectors, and queries, that a task holds.
BLOCK, QUERY_BLOCK = 8192, 4096
#: Share of a block that is reranked for a query, at every size; SPARE times as many as are asked for at least.
SHARE, SPARE = 0.3, 4


def usable(vector: str) -> Column:
    """Whether a vector has only finite components, not all of them zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)


def prefixes(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector, in order."""
    prefix = min(prefix, len(pivots))
    near = vectors @ pivots.T
    some = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(some, np.lexsort((some, -np.take_along_axis(near, some, 1)), axis=1), 1)


class InvertedFiles:
    """Postings of the vectors of a block: ``rows`` and the weights PREFIX - rank by pivot; file p is begin[p]:begin[p + 1]."""

    def __init__(self, points: np.ndarray, pivots: np.ndarray, prefix: int):
        self.pivots, self.prefix, self.size = pivots, prefix, len(points)
        order = prefixes(points, pivots, prefix)
        by_pivot = np.argsort(order, axis=None, kind="stable")
        self.rows = (by_pivot // order.shape[1]).astype(np.int32)
        self.weights = (prefix - by_pivot % order.shape[1]).astype(np.int32)
        self.begin = np.searchsorted(order.ravel()[by_pivot], np.arange(len(pivots) + 1))

    def near(self, asked: np.ndarray) -> np.ndarray:
        """What each vector has in common with the query that has the pivots ``asked``: more is a smaller footrule distance; 0 is not found."""
        files = [slice(self.begin[p], self.begin[p + 1]) for p in asked]
        rows = np.concatenate([self.rows[f] for f in files])
        common = np.concatenate([np.minimum(self.weights[f], self.prefix - i) for i, f in enumerate(files)])
        return np.bincount(rows, common, self.size)


def reranked(block: int, k: int, share: float = SHARE) -> int:
    """How many vectors of a block are reranked for a query."""
    return min(block, max(SPARE * k, math.ceil(block * share)))


def search_block(points: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int, prefix: int = PREFIX, share: float = SHARE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (row indexes of points, scores) of the k best that the block's index finds."""
    index = InvertedFiles(points, pivots, prefix)
    best = reranked(len(points), k, share)
    out = []
    for q, asked in zip(queries, prefixes(queries, pivots, prefix), strict=True):
        near = index.near(asked)
        rows = np.argpartition(near, len(near) - best)[len(near) - best :] if best < len(near) else np.arange(len(near))
        if best > k:  # of those that share nothing with the query only as many as make up k
            found = near[rows] > 0
            rows = rows[found] if found.sum() >= k else rows
        rows.sort()
        scores = points[rows] @ q
        if len(rows) > 4 * k:  # more than k, so that no tie is cut off
            rows = rows[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
        out.append((rows, np.array([np.dot(points[r], q) for r in rows])))
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", prefix: int = PREFIX, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query row, itself excepted."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), is_query.alias("q")).filter(F.col("id").isNotNull() & usable("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    rows = rows.filter(F.size("v") == lengths["d"]).withColumn("g", F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(half), "v")), 16, "0") for half in (1, 2)]))  # 128 bits tell vectors apart

    # ids of each distinct vector, no more than a result needs, and its vector once
    first = Window.partitionBy("g").orderBy("id")
    members = rows.select("g", "id").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    members = materialize(members.groupBy("g").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-members")
    distinct = materialize(rows.groupBy("g").agg(F.first("v").alias("v"), F.max("q").alias("q")), "ann-vectors")
    n, n_q = distinct.agg(F.count("*"), F.count_if("q")).first()
    pivots = np.array([list(map(float, r["v"])) for r in distinct.orderBy(F.xxhash64(F.lit(17), "g"), "g").limit(PIVOTS).select("v").collect()])

    blocks, q_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_q // QUERY_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    held = distinct.select("g", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int").alias("block"), every(q_blocks).alias("part"))
    asks = distinct.filter("q").select("g", "v", F.lit(True).alias("asks"), F.pmod(F.xxhash64("g", F.lit(3)), F.lit(q_blocks)).cast("int").alias("part"), every(blocks).alias("block"))

    def search(cell):
        import pandas as pd

        cell = cell.sort_values("g")  # of equal footrule distances at the cut a rerun takes the same
        mine, theirs = cell[~cell["asks"]], cell[cell["asks"]]
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"qg": np.zeros(0, object), "g": np.zeros(0, object), "score": np.zeros(0)})
        points, queries = (np.stack(side["v"].to_numpy()).astype(np.float64) for side in (mine, theirs))
        found = search_block(points, queries, pivots, k + 1, prefix, share)
        return pd.DataFrame({"qg": np.repeat(theirs["g"].to_numpy(), [len(r) for r, _ in found]), "g": mine["g"].to_numpy()[np.concatenate([r for r, _ in found])], "score": np.concatenate([s for _, s in found])})

    found = held.unionByName(asks).groupBy("block", "part").applyInPandas(search, "qg string, g string, score double")
    order = Window.partitionBy("qg").orderBy(F.desc("score"), F.col("ids")[0])
    reps = found.join(members, "g").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    ids = reps.select("qg", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("qg").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1).drop("n")
    queries = rows.filter("q").select(F.col("g").alias("qg"), F.col("id").alias("query_id")).distinct()
    hits = queries.join(ids, "qg").filter("vec_id <> query_id")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "qg").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
