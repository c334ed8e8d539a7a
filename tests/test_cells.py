"""Distinct counts from bitmaps over dense numbers: exact, mergeable, small."""

from __future__ import annotations

from pyspark.sql import functions as F

from __spark_entry__ import BLOCKBUSTER
from vitrine.operators.bitmaps import bitmap_cells, entity_numbers, roll_up, with_numbers
from vitrine.plans import cells, genre, platform
from vitrine.plans.pipeline import genres_of


def rows(df):
    return sorted(
        tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()
    )


def test_reports_equal_the_direct_ones(catalog):
    stored, genres = cells.store_cells(catalog), genres_of(catalog)
    assert rows(cells.genre_counts(stored)) == rows(genre.genre_counts(genres))
    assert rows(cells.genre_reviews(stored)) == rows(genre.genre_reviews(genres))
    assert rows(cells.genre_platforms(stored)) == rows(genre.genre_platforms(genres))
    assert rows(cells.profile_quality(stored)) == rows(platform.profile_quality(catalog))
    assert rows(cells.blockbuster_genres(catalog, **BLOCKBUSTER)) == rows(genre.blockbuster_genres(genres, **BLOCKBUSTER))


def test_loads_merge_and_products_seen_twice_count_once(catalog):
    part = F.col("app_id") % 3
    loads = [catalog.filter(part == 0), catalog.filter(part == 1), catalog.filter(part != 1)]
    stored = None
    for load in loads:
        stored = cells.store_cells(load, stored)
    assert stored.numbers.count() == stored.numbers.select("product_no").distinct().count()
    assert rows(cells.genre_counts(stored)) == rows(genre.genre_counts(genres_of(catalog)))


def test_null_and_repeated_entities(spark):
    data = [("a", 1), ("a", 1), ("a", None), ("b", 1), ("b", 10**12), ("c", None), (None, -5)]
    df = spark.createDataFrame(data, "key string, app_id long")
    numbers = entity_numbers(df, "app_id", ["key"])
    assert sorted(r["product_no"] for r in numbers.collect()) == [0, 1, 2]
    made = bitmap_cells(with_numbers(df, numbers, "app_id"), ["key"], {"n": "count(1)"})
    got = {r["key"]: (r["d"], r["n"]) for r in roll_up(made, ["key"], "d", ["n"]).collect()}
    assert got == {"a": (1, 3), "b": (2, 2), "c": (0, 1), None: (1, 1)}


def test_dense_numbers_keep_the_cells_few(spark):
    ids = spark.range(200_000).select((F.col("id") * 7919).alias("app_id"), (F.col("id") % 5).cast("int").alias("release_year"))
    numbered = with_numbers(ids, entity_numbers(ids, "app_id", ["release_year"]), "app_id")
    made = bitmap_cells(numbered, ["release_year"])
    # 200,000 numbers are 7 bitmaps; a year's neighbours share them, so each border adds one at most
    assert made.count() <= 7 + 5


def test_products_are_not_shuffled_per_genre(catalog):
    products, _ = cells.numbered_products(catalog)
    made = bitmap_cells(genres_of(products), ["genre"])
    plan = roll_up(made, ["genre"], "n", [])._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not any("genre" in line and "app_id" in line for line in shuffles)
    assert "partial_bitmap_construct_agg" in plan and "partial_bitmap_or_agg" in plan
