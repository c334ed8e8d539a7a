"""Distinct counts that can be stored and merged: bitmaps over dense entity numbers.

``count_distinct(app_id)`` per genre shuffles every (genre, app_id). A bitmap of 32,768 entity numbers is 4 KB, is built in the map
tasks, and two of them merge by OR, so distinct counts of fine cells roll up exactly to coarser ones. Entities are
numbered gapless in the order of the cells they lie in: then a bitmap of a cell is full, not one bit
in 4 KB, and a table of cells stays far smaller than the pairs it stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import dense_numbers

NUMBER, BUCKET, BITS = "product_no", "bitmap_bucket", "bitmap"


def entity_numbers(
    df: DataFrame, entity: str, near: list[str], out: str = NUMBER, known: DataFrame | None = None, **params
) -> DataFrame:
    """``entity, out``: every distinct entity (NULL left out) with a number, gapless, in the order of ``near`` (the
    least of an entity's rows), so that entities of one cell have neighbouring numbers.

    ``known``, an earlier result, keeps its numbers; new entities are numbered after its last.
    """
    near_of = F.min(F.struct(*near)).alias("__b_near")
    entities = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(near_of)
    start = 0
    if known is not None:
        entities = entities.join(known.select(entity), entity, "left_anti")
        last = known.agg(F.max(out)).first()[0]
        start = 0 if last is None else last + 1
    flat = entities.select(entity, *[F.col(f"__b_near.{c}").alias(f"__b_{c}") for c in near])
    numbered = dense_numbers(flat, [*[f"__b_{c}" for c in near], entity], out, start, **params).select(entity, out)
    return numbered if known is None else known.select(entity, out).unionByName(numbered)


def with_numbers(df: DataFrame, numbers: DataFrame, entity: str, out: str = NUMBER) -> DataFrame:
    """``df`` plus the number of each row's entity (NULL for a NULL entity). An entity with very many rows is
    split by AQE's skew join."""
    names = numbers.select(F.col(entity).alias("__b_entity"), out)
    return df.join(names, F.col(entity) == F.col("__b_entity"), "left").drop("__b_entity")


def bitmap_cells(df: DataFrame, keys: list[str | Column], measures: dict[str, str] | None = None, number: str = NUMBER) -> DataFrame:
    """``keys``, ``bitmap_bucket``, ``bitmap`` and additive ``measures`` (SQL aggregates whose parts add up: counts and sums).

    Built in the map tasks: the shuffle carries one row per task and (cell, bucket), not one per (cell, entity).
    Rows without a number are in the measures (bucket NULL) and in no distinct count.
    """
    aggregates = [F.expr(agg).alias(name) for name, agg in (measures or {}).items()]
    return df.groupBy(*keys, F.bitmap_bucket_number(number).alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(BITS), *aggregates
    )


def merge_cells(parts: list[DataFrame], keys: list[str], measures: list[str]) -> DataFrame:
    """Cells of several tables (one per load) as one: bitmaps OR, measures add up. An entity in two loads counts once;
    rows of both count in the measures, so a load must not repeat rows."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return roll_up_bitmaps(every, keys, measures)


def roll_up_bitmaps(cells: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Cells of fewer keys, still mergeable."""
    return cells.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS), *[F.sum(m).alias(m) for m in measures])


def roll_up(cells: DataFrame, keys: list[str], distinct: str, measures: list[str]) -> DataFrame:
    """One row per ``keys``: the exact number of distinct entities, and the measures' sums. Reads stored cells only."""
    merged = roll_up_bitmaps(cells, keys, measures)
    return merged.groupBy(*keys).agg(
        F.sum(F.bitmap_count(BITS)).alias(distinct), *[F.sum(m).alias(m) for m in measures]
    )
