"""Bottom-k samples and bounded densities."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators.sampling import bottom_k, density
from vitrine.plans import charts


@pytest.fixture(scope="module")
def rows(spark):
    out = [("big" if i % 10 else ("small" if i % 100 else None), i, float(i % 7)) for i in range(3000)]
    return spark.createDataFrame(out, "s string, id long, x double")


def ids(df):
    return sorted((str(r["s"]), r["id"], r["inclusion"]) for r in df.collect())


def test_k_of_each_stratum_whatever_the_partitions(rows):
    got = ids(bottom_k(rows, ["s"], "id", 25))
    assert got == ids(bottom_k(rows.repartition(13, "x"), ["s"], "id", 25)) == ids(bottom_k(rows.coalesce(1), ["s"], "id", 25))
    assert {s: sum(r[0] == s for r in got) for s in ("big", "small", "None")} == {"big": 25, "small": 25, "None": 25}
    assert ids(bottom_k(rows, ["s"], "id", 25, salt="other")) != got


def test_a_stratum_of_few_rows_is_whole(rows):
    got = ids(bottom_k(rows.filter("id < 200"), ["s"], "id", 25))
    assert [r for r in got if r[0] == "None"] == [("None", 0, 1.0), ("None", 100, 1.0)]
    assert bottom_k(rows.limit(0), ["s"], "id", 3).count() == 0


def test_samples_merge(rows):
    parts = [bottom_k(rows.filter(F.col("id") % 2 == i), ["s"], "id", 26).drop("inclusion") for i in (0, 1)]
    assert ids(bottom_k(parts[0].unionAll(parts[1]), ["s"], "id", 25)) == ids(bottom_k(rows, ["s"], "id", 25))


def test_weighted_sums_are_unbiased(rows):
    estimates = []
    for salt in range(30):
        sample = bottom_k(rows, [], "id", 100, salt=f"{salt}-").agg(F.sum(F.col("x") / F.col("inclusion"))).first()[0]
        estimates.append(sample)
    truth = rows.agg(F.sum("x")).first()[0]
    assert abs(sum(estimates) / len(estimates) / truth - 1) < 0.05


def test_a_task_hands_on_few_rows_of_a_stratum(rows):
    plan = bottom_k(rows, ["s"], "id", 25)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("max_cells", [2, 30, 300])
def test_density_is_bounded_and_counts_every_point(spark, max_cells):
    rnd = random.Random(5)
    points = [(i, rnd.gauss(0, 1) if i % 3 else 2.0, rnd.gauss(0, 1) if i % 3 else 2.0) for i in range(4000)]
    points += [(5000, None, 1.0), (5001, float("nan"), 1.0), (5002, float("inf"), 0.0)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    found = density(df, "x", "y", "id", max_cells, per_cell=2)
    cells, sample = found.cells.collect(), found.sample.collect()
    assert sum(c["n"] for c in cells) == 4000 and len(cells) <= max_cells
    assert sum(s["weight"] for s in sample) == 4000 and len(sample) <= 2 * len(cells)
    held = {(c["depth"], c["ix"], c["iy"]): c for c in cells}
    counted = dict.fromkeys(held, 0)
    for s in sample:
        c = held[s["depth"], s["ix"], s["iy"]]
        assert c["x_from"] - 1e-9 <= s["x"] <= c["x_to"] + 1e-9 and c["y_from"] - 1e-9 <= s["y"] <= c["y_to"] + 1e-9
        counted[s["depth"], s["ix"], s["iy"]] += s["weight"]
    assert all(counted[k] == c["n"] for k, c in held.items())
    assert rows_of(density(df.repartition(9), "x", "y", "id", max_cells).sample) == rows_of(density(df, "x", "y", "id", max_cells).sample)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_density_of_one_point_and_of_none(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)] * 5, "id long, x double, y double")
    found = density(df, "x", "y", "id", 10)
    assert [c["n"] for c in found.cells.collect()] == [5] and [s["weight"] for s in found.sample.collect()] == [5]
    assert density(df.limit(0), "x", "y", "id", 10).cells.count() == 0


def test_scatter_of_the_catalog(catalog):
    found = charts.price_density(catalog, 50)
    assert found.cells.count() <= 50
    assert found.cells.agg(F.sum("n")).first()[0] == charts.price_points(catalog).count()
