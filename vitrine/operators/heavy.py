"""Exact top-k by count without counting every key.

``groupBy(key).count()`` shuffles one row per (task, key): with nearly as many keys as rows that is the table itself, for a report
of 50 rows. Here a mergeable frequent-items sketch proposes candidates. One pass then counts
the candidates exactly and all other rows in a fixed number of hash buckets, which proves how
often any key that was not proposed can occur at most. Only keys in buckets that reach the k-th candidate have to be counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .topk import top_k

# Items a sketch tracks, hash buckets for the other rows, and the width of the sketches' first merge level.
TRACKED, BUCKETS, FANOUT = 4_000, 1 << 16, 256


@dataclass
class HeavyHitters:
    """``top``: the k most frequent keys (``key, count``), exact. ``bound``: no key outside the candidates occurs more
    often. ``kth``: the k-th candidate's count. ``open_buckets``: buckets whose keys had to be counted; 0 means the sketch
    was wide enough. ``wider``: tracked items at which the bound would fall below ``kth`` (None where no width helps)."""

    top: DataFrame
    bound: int
    kth: int
    open_buckets: int
    wider: int | None


def frequent_candidates(df: DataFrame, key: str, tracked: int = TRACKED, fanout: int = FANOUT) -> DataFrame:
    """``key`` of at most ``tracked`` keys that a frequent-items sketch keeps. Sketches are merged as a two-level tree, so no
    reducer takes one per map task; a rare key among them does no harm."""
    name = f"`{key}`"
    level1 = (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.pmod(F.spark_partition_id(), F.lit(fanout)).alias("__h_s"))
        .agg(F.expr(f"approx_top_k_accumulate({name}, {tracked})").alias("s"))
    )
    # grouped by a constant: sketches of no rows at all cannot be combined
    items = level1.groupBy(F.lit(0).alias("__h_all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {tracked}), {tracked})").alias("items"))
    return items.select(F.explode("items.item").alias(key))


def heavy_hitters(
    df: DataFrame, key: str, k: int, count_col: str = "count", tracked: int = TRACKED, buckets: int = BUCKETS
) -> HeavyHitters:
    """The ``k`` most frequent values of ``key``; NULL is a value like any other, ties go to the smaller value (NULL last).

    Two passes over ``df``. If the k-th candidate occurs more often than the fullest bucket of other rows, the
    candidates' counts are the answer. Else a third pass counts the keys of the buckets that reach it: a wider sketch
    would have spared that, and the result says how wide. Exact in every case, also where all keys occur once.
    The candidates (at most ``tracked``) and the open buckets (at most ``buckets`` numbers) are broadcast; the
    driver sees the counts of the buckets' maximum and of the k-th candidate.
    """
    keys = df.select(F.col(key))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    candidates = materialize(frequent_candidates(keys, key, tracked), "heavy-candidates").withColumn("__h_c", F.lit(True))
    marked = keys.join(F.broadcast(candidates), key, "left")
    chosen = F.col("__h_c").isNotNull() | F.col(key).isNull()
    # one row per candidate, one per bucket of others
    counted = materialize(
        marked.groupBy(
            F.when(chosen, F.col(key)).alias(key), F.when(~chosen, bucket).alias("__h_b")
        ).agg(F.count(F.lit(1)).alias(count_col)),
        "heavy-counts",
    )
    exact = counted.filter(F.col("__h_b").isNull()).select(key, count_col)
    others = counted.filter(F.col("__h_b").isNotNull())
    best = top_k(exact, [f"-{count_col}"], k, tie_break=[key])
    seen = best.agg(F.count(F.lit(1)).alias("n"), F.min(count_col).alias("kth")).first()
    kth = seen["kth"] if seen["n"] == k else 0
    # a bucket that only reaches the k-th count may hold a tie with a smaller value
    row = others.agg(
        F.max(count_col).alias("bound"), F.count_if(F.col(count_col) >= kth).alias("open"), F.sum(count_col).alias("rest")
    ).first()
    bound, is_open = row["bound"] or 0, row["open"]
    if is_open == 0:
        return HeavyHitters(best, bound, kth, 0, tracked)
    reach = others.filter(F.col(count_col) >= kth).select(F.col("__h_b").alias("__h_open"))
    again = (
        marked.filter(~chosen)
        .join(F.broadcast(reach), bucket == F.col("__h_open"), "left_semi")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias(count_col))
    )
    result = top_k(exact.unionAll(again.select(key, count_col)), [f"-{count_col}"], k, tie_break=[key])
    # the bound of a frequent-items sketch: 3.5 times the rows over its size
    wider = -(-7 * row["rest"] // (2 * kth)) if kth > 1 else None
    return HeavyHitters(result, bound, kth, is_open, wider)
