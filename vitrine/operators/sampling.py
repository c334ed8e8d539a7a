"""Samples that can be merged, repeated and weighted: bottom-k by a keyed hash, and the density of a point cloud.

A row's hash depends on its key alone, so a sample does not depend on files, partitions or order; the k smallest hashes of two loads
hold the k smallest of both. The (k+1)-th hash is the chance each of the k had, which makes weighted sums of a sample unbiased.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LUCK_DIGITS = 13


def luck(key: str, salt: str = "") -> Column:
    """A number in [0, 1) from the key's text, 52 bits of its MD5: the same on every engine. A NULL key is the text ``''``."""
    text = F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, LUCK_DIGITS), 16, 10).cast("bigint").cast("double") / float(16**LUCK_DIGITS)


def bottom_k(df: DataFrame, strata: list[str], key: str, k: int, salt: str = "", inclusion: str = "inclusion") -> DataFrame:
    """``df``'s rows with the ``k`` smallest hashes of ``key`` in each stratum (all, if there are fewer), plus ``inclusion``, the chance each had.

    ``key`` tells rows apart; rows that share one are in or out by their order, so give a unique key. NULL strata are strata.
    ``sum(x / inclusion)`` over the sample is an unbiased estimate of the sum of ``x`` over the stratum. Planned as a window with a
    group limit: a task hands on k + 1 rows of a stratum at most, so a stratum of most rows is no large group.
    """
    place, chance, limit = "__s_place", "__s_luck", "__s_limit"
    order = Window.partitionBy(*strata).orderBy(chance, F.col(key).asc_nulls_first())
    ranked = df.withColumn(chance, luck(key, salt)).withColumn(place, F.row_number().over(order)).filter(F.col(place) <= k + 1)
    whole = Window.partitionBy(*strata)
    judged = ranked.withColumn(limit, F.max(F.when(F.col(place) == k + 1, F.col(chance))).over(whole))
    chosen = judged.filter(F.col(place) <= k).withColumn(inclusion, F.coalesce(F.col(limit), F.lit(1.0)))
    return chosen.drop(place, chance, limit)


@dataclass
class Density:
    """``cells``: ``depth, ix, iy, x_from, x_to, y_from, y_to, n``, disjoint, whose ``n`` add up to the points. ``sample``: a few points of each
    cell with ``weight``, the points of the cell each stands for."""

    cells: DataFrame
    sample: DataFrame


def density(df: DataFrame, x: str, y: str, key: str, max_cells: int = 1000, per_cell: int = 1, levels: int = 8, salt: str = "") -> Density:
    """A point cloud as at most ``max_cells`` cells and ``max_cells * per_cell`` sampled points, at any number of points.

    The bounding square is quartered, and each quarter again while it holds more than T points, down to a grid of ``2**levels`` a side. With
    T = 3 * levels * points / (max_cells - 1) there are at most ``max_cells`` cells, because fewer than points / T cells of a level can hold
    more than T and each adds three. Points without both coordinates, or with one that is not finite, are left out.

    Two passes count: bounds, and points per finest cell, combined in the tasks (at most ``4**levels`` rows, which is what
    is broadcast to send every point to its cell for the sample, the third). A sample keeps, of each cell, the
    smallest keyed hash in each of ``per_cell`` slots, as one mergeable aggregate.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    points = df.select(
        F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    ).filter(finite("x") & finite("y"))
    b = points.agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    ).first()
    side = 1 << levels
    limit = max(1, -(-3 * levels * b["n"] // max(max_cells - 1, 1)))

    def place(c: str, low: float | None, high: float | None) -> Column:
        if low is None or not high > low:
            return F.lit(0)
        return F.least(F.floor((F.col(c) - low) / (high - low) * side).cast("int"), F.lit(side - 1))

    placed = points.withColumns({"gx": place("x", b["x0"], b["x1"]), "gy": place("y", b["y0"], b["y1"])})
    finest = placed.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"))
    # every finest cell with its count on each level; the first that is small enough is its leaf
    depths = F.sequence(F.lit(0), F.lit(levels))
    shift = F.lit(levels) - F.col("depth")
    at = finest.withColumn("depth", F.explode(depths)).withColumns(
        {"ix": F.expr(f"shiftright(gx, {levels} - depth)"), "iy": F.expr(f"shiftright(gy, {levels} - depth)")}
    )
    held = Window.partitionBy("depth", "ix", "iy")
    small = (F.sum("n").over(held) <= limit) | (shift == 0)
    leaves = (
        at.withColumn("small", small).filter("small").groupBy("gx", "gy")
        .agg(F.min(F.struct("depth", "ix", "iy", "n")).alias("leaf"))
        .select("gx", "gy", "leaf.*")
    )

    def edge(i: Column, low: float | None, high: float | None) -> Column:
        width = 0.0 if low is None else high - low
        return F.lit(low).cast("double") + F.lit(width) * i / F.pow(F.lit(2.0), F.col("depth"))

    cells = (
        leaves.groupBy("depth", "ix", "iy")
        .agg(F.sum("n").alias("n"))
        .select(
            "depth", "ix", "iy", edge(F.col("ix"), b["x0"], b["x1"]).alias("x_from"), edge(F.col("ix") + 1, b["x0"], b["x1"]).alias("x_to"),
            edge(F.col("iy"), b["y0"], b["y1"]).alias("y_from"), edge(F.col("iy") + 1, b["y0"], b["y1"]).alias("y_to"), "n",
        )
    )
    chance = luck("key", salt)
    slot = F.least(F.floor(chance * per_cell).cast("int"), F.lit(per_cell - 1))
    sample = (
        placed.join(F.broadcast(leaves.drop("n")), ["gx", "gy"])
        .groupBy("depth", "ix", "iy", slot.alias("slot"))
        .agg(F.min(F.struct(chance.alias("luck"), "key", "x", "y")).alias("p"), F.count(F.lit(1)).alias("weight"))
        .select("depth", "ix", "iy", F.col("p.key").alias(key), F.col("p.x").alias(x), F.col("p.y").alias(y), "weight")
    )
    return Density(cells, sample)
