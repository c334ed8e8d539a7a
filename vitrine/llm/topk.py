"""Exact top-k by inner product without random access.

Each component of a block of vectors is a list sorted by value. The lists are read in step, from the top for a query's
positive components and from the bottom for its negative ones. What has been read gives each vector a
lower and an upper bound on its score; reading stops for a vector whose upper bound is below the k-th best
lower bound, and the scores of those that are left are resolved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import materialize, parts_for

# Vectors and queries of one block pair.
CANDIDATES = 8192
QUERIES = 512
# Depths, as shares of the lists, at which bounds are compared.
DEPTHS = (1 / 64, 1 / 16, 1 / 4, 1 / 2)
# Whole numbers up to this are exact in the floating-point products below.
EXACT = 2.0**52


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


def block_top_k(
    ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """``(query position, candidate position, score)`` of at least the best ``k`` of a block for each query, ties at the
    end included; a vector with the query's id takes no part."""
    n, dims = x.shape
    wide = max(np.abs(x).max(initial=0), 1) * max(np.abs(q).max(initial=0), 1) * max(dims, 1)
    if wide > EXACT:  # beyond exact floating point: whole numbers of any size
        return _whole_numbers(ids, x, query_ids, q, k)
    positive, negative = np.maximum(q, 0).T, np.minimum(q, 0).T
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
    low, high = x.min(axis=0), x.max(axis=0)
    own = ids[:, None] == query_ids[None, :]
    alive = ~own
    if n > 4 * k:
        for share in DEPTHS:
            depth = max(k, int(n * share))
            if depth >= n:
                break
            # Read from the top: the rest is at most the value at the frontier, and at least the list's last.
            top = rank >= n - depth
            front_top = np.take_along_axis(order, np.full((1, dims), n - depth), axis=0)
            most = np.where(top, x, np.take_along_axis(x, front_top, axis=0))
            least = np.where(top, x, low)
            # Read from the bottom: the rest is at least the frontier's value, and at most the list's first.
            bottom = rank < depth
            front_bottom = np.take_along_axis(order, np.full((1, dims), depth - 1), axis=0)
            below = np.where(bottom, x, np.take_along_axis(x, front_bottom, axis=0))
            above = np.where(bottom, x, high)
            upper = most @ positive + below @ negative
            lower = least @ positive + above @ negative
            lower[~alive] = -np.inf
            kth = -np.partition(-lower, k - 1, axis=0)[k - 1]
            alive &= upper >= kth
            if alive.sum() <= 4 * k * len(q):
                break
    out = []
    for j in range(len(q)):
        left = np.flatnonzero(alive[:, j])
        if len(left):
            scores = x[left] @ q[j]
            if len(left) > k:
                best = scores >= -np.partition(-scores, k - 1)[k - 1]
                left, scores = left[best], scores[best]
            out += zip([j] * len(left), left.tolist(), scores.astype(np.int64).tolist())
    return out


def _whole_numbers(ids, x, query_ids, q, k):
    out = []
    whole = [[int(v) for v in row] for row in x]
    for j, query in enumerate(q):
        query = [int(v) for v in query]
        scores = [(-sum(a * b for a, b in zip(query, row)), int(ids[i]), i) for i, row in enumerate(whole) if ids[i] != query_ids[j]]
        for s, _, i in sorted(scores)[:k]:
            if not -(1 << 63) <= -s < 1 << 63:
                raise OverflowError("an inner product does not fit a long")
            out.append((j, i, -s))
    return out


def _search(k: int):
    schema_names = ["query_id", "_h", "vec_id", "score"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, part in pdf.groupby(pdf["_x"].map(len), sort=False):  # inner products need equal lengths
            ask, have = part[part["_ask"]], part[~part["_ask"]]
            if not len(ask) or not len(have):
                continue
            x, q = np.stack(have["_x"].to_list()), np.stack(ask["_x"].to_list())
            ids, query_ids, hashes = have["_id"].to_numpy(), ask["_id"].to_numpy(), ask["_h"].to_numpy()
            found = block_top_k(ids, x.reshape(len(have), -1), query_ids, q.reshape(len(ask), -1), k)
            # Of a block, the best k by (score, smaller id) are enough.
            best = pd.DataFrame(
                [(query_ids[j], hashes[j], ids[i], s) for j, i, s in found], columns=schema_names
            ).sort_values(["query_id", "_h", "score", "vec_id"], ascending=[True, True, False, True])
            rows.append(best.groupby(["query_id", "_h"], sort=False).head(k))
        return pd.concat(rows) if rows else pd.DataFrame({c: pd.Series(dtype="int64") for c in schema_names})

    return run


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` vectors (all, if fewer) with the largest inner product of
    the components floor(scale * x), ties to the smaller id; vectors with the query's id take no part.

    Vectors that are null or have null or non-finite components take no part, nor do null ids. Rows that repeat an (id, vector)
    pair count once, as vector and as query; one id's different vectors are each a vector and a query; vectors of another length than the query are no candidates. Empty tables give no rows.
    A score beyond a long raises.

    Queries meet all vectors block by block: vectors and queries are dealt evenly to blocks of at most about ``CANDIDATES`` and
    ``QUERIES`` rows, each pair of blocks is one task's bounded work, and it returns k rows a query.
    """

    def prepared(df: DataFrame, name: str, block: int) -> tuple[DataFrame, int]:
        rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
            F.col(id_col).cast("long").alias("_id"), quantised(F.col(vector_col), scale).alias("_x")
        )
        rows = materialize(rows.distinct(), name)
        parts = parts_for(rows.count(), block)
        rows = rows.withColumn("_h", F.xxhash64("_x"))
        return rows.withColumn("_part", F.pmod(F.xxhash64("_id", "_h"), F.lit(parts)).cast("int")), parts

    have, blocks = prepared(vectors, "vectors", CANDIDATES)
    ask, groups = prepared(queries, "queries", QUERIES)
    # Pair (i, j) is numbered i * groups + j; a vector goes to its block's pairs, a query to its group's.
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pairs = have.withColumn("_j", spread(groups)).select(
        "_id", "_x", "_h", F.lit(False).alias("_ask"), (F.col("_part") * groups + F.col("_j")).alias("_pair")
    ).unionAll(
        ask.withColumn("_i", spread(blocks)).select(
            "_id", "_x", "_h", F.lit(True).alias("_ask"), (F.col("_i") * groups + F.col("_part")).alias("_pair")
        )
    )
    found = pairs.groupBy("_pair").applyInPandas(_search(k), "query_id long, _h long, vec_id long, score long")
    order = Window.partitionBy("query_id", "_h").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
