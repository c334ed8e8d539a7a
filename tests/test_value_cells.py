"""Quantiles, means and extremes from stored value cells: equal to the exact reports, appended without rereading."""

from __future__ import annotations

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators.quantiles import exact_quantiles
from vitrine.operators.stats import numeric_summary
from vitrine.operators.value_cells import store_values, stored_moments, stored_quantiles, stored_values, value_cell
from vitrine.plans import pricing
from vitrine.plans.pipeline import genres_of

PROBS, NAMES = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0], ["q0", "q1", "q2", "q3", "q4", "q5"]


def rows(df):
    digits = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(str([digits(v) for v in r]) for r in df.collect())


@pytest.fixture(scope="module")
def loads(spark):
    rnd = random.Random(11)

    def load(n):
        out = []
        for _ in range(n):
            g = rnd.choice(["a", "a", "a", "b", None, "c"])
            v = rnd.choice([rnd.uniform(-5, 900), rnd.randint(1, 4) / 1.0, 0.0, -0.0, 5.99, 1e-320, 1e300, None])
            out.append((g, rnd.randint(2000, 2003), None if g == "c" else v))
        return spark.createDataFrame(out, "g string, y int, v double")

    return [load(n) for n in (700, 1, 400)]


@pytest.mark.parametrize("discrete", [True, False])
@pytest.mark.parametrize("groups", [[], ["g"], ["g", "y"]])
def test_equal_to_the_exact_quantiles(spark, loads, tmp_path, groups, discrete):
    path, every = str(tmp_path / "cells"), loads[0]
    for load in loads:
        store_values(load, ["g", "y"], "v", path)
    for load in loads[1:]:
        every = every.unionByName(load)
    want = exact_quantiles(every, "v", PROBS, NAMES, groups, discrete)
    got = stored_quantiles(spark, path, PROBS, NAMES, groups, discrete)
    assert rows(got.select(*groups, *NAMES)) == rows(want.select(*groups, *NAMES))


def test_moments(spark, tmp_path):
    rnd = random.Random(3)
    values = [(i % 3, 1e6 + rnd.random() if i % 11 else None) for i in range(900)]
    df, path = spark.createDataFrame(values, "g int, v double"), str(tmp_path / "cells")
    for part in (F.col("g") == 0, F.col("g") != 0):
        store_values(df.filter(part), ["g"], "v", path)
    for groups in ([], ["g"]):
        want = df.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n"), F.avg("v").alias("mean"),
            F.stddev_samp("v").alias("stddev"), F.min("v").alias("least"), F.max("v").alias("most"),
        )
        close = lambda a, b: a == b or math.isclose(a, b, rel_tol=1e-4)
        got = stored_moments(spark, path, groups)
        for a, b in zip(sorted(got.collect()), sorted(want.collect())):
            assert all(close(x, y) for x, y in zip(a, b)), (a, b)


def test_cells_never_fall_as_values_grow(spark):
    inf = float("inf")
    values = [-inf, -1e300, -2.5, -1.0, -1e-320, 0.0, 1e-320, 0.9999, 1.0, 1.05, 2.0, 5e7, 1e308, inf, float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").withColumn("cell", value_cell(F.col("v")))
    cells = [r["cell"] for r in df.orderBy("i").collect()]
    assert cells == sorted(cells) and len(set(cells)) >= len(cells) - 1


def test_appending_leaves_old_files_and_reports_agree(spark, catalog, tmp_path):
    path, genres, first = str(tmp_path / "genres"), genres_of(catalog), F.col("app_id") % 4 == 0
    pricing.store_genre_prices(genres.filter(first), path)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}
    before = files()
    pricing.store_genre_prices(genres.filter(~first), path)
    after = files()
    assert all(after[f] == t for f, t in before.items()) and len(after) > len(before)
    columns = ["genre", "nb_games", "avg_price_eur", "median_price_eur"]
    assert rows(pricing.price_by_genre_stored(spark, path).select(*columns)) == rows(pricing.price_by_genre(genres).select(*columns))
    prices = str(tmp_path / "prices")
    pricing.store_prices(catalog, prices)
    assert rows(pricing.price_summary_stored(spark, prices)) == rows(numeric_summary(pricing.paid_prices(catalog), "price"))


def test_only_wanted_cells_are_read(spark, loads, tmp_path):
    path = str(tmp_path / "cells")
    store_values(loads[0], ["g"], "v", path)
    plan = stored_quantiles(spark, path, [0.5], ["m"], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan or "PushedFilters: [IsNotNull(cell), In(cell" in plan or "EqualTo(cell" in plan
    assert stored_values(spark, path).count() < loads[0].count()


def test_an_empty_store(spark, loads, tmp_path):
    path = str(tmp_path / "cells")
    store_values(loads[0].limit(0), ["g"], "v", path)
    assert stored_quantiles(spark, path, [0.5], ["m"], ["g"]).count() == 0
    assert stored_quantiles(spark, path, [0.5], ["m"]).first()["m"] is None
    assert stored_moments(spark, path).first()["n"] == 0
