"""Running totals, dense numbers, average ranks and the rank correlation, over many ranges."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest

from vitrine.operators.ranks import average_ranks, dense_numbers, rank_correlation, running_totals


@pytest.mark.parametrize("ranges", [1, 7])
def test_running_totals_in_key_order(spark, ranges):
    rnd = random.Random(4)
    rows = [(k, rnd.randint(0, 9)) for k in rnd.sample(range(5000), 900)]
    got = running_totals(spark.createDataFrame(rows, "k long, n long"), ["k"], "n", ranges=ranges).collect()
    before, want = 0, []
    for k, n in sorted(rows):
        want.append((k, n, before))
        before += n
    assert sorted((r["k"], r["n"], r["before"]) for r in got) == want


def test_numbers_are_gapless_and_nulls_come_first(spark):
    rows = [(None, "b"), (None, "a"), (2, "x"), (1, None), (1, "z")]
    df = spark.createDataFrame(rows, "y int, s string")
    got = {(r["y"], r["s"]): r["no"] for r in dense_numbers(df, ["y", "s"], "no", start=5, ranges=3).collect()}
    assert got == {(None, "a"): 5, (None, "b"): 6, (1, None): 7, (1, "z"): 8, (2, "x"): 9}
    assert dense_numbers(df.limit(0), ["y", "s"], "no").count() == 0


@pytest.mark.parametrize("range_rows", [50, 10**6])
def test_average_ranks_with_a_value_that_most_rows_have(spark, range_rows):
    rnd = random.Random(6)
    values = [0.5 if rnd.random() < 0.6 else rnd.randint(0, 400) / 7 for _ in range(2000)] + [None] * 20
    got = average_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v", range_rows=range_rows).collect()
    want = pd.Series([v for v in values if v is not None]).rank()
    by_value = dict(zip([v for v in values if v is not None], want))
    assert {r["v"]: r["rank"] for r in got} == by_value


def test_rank_correlation(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 30) / 3) for _ in range(1500)]
    rows = [(x, y + x) for x, y in rows] + [(None, 1.0), (1, None)]
    got = rank_correlation(spark.createDataFrame(rows, "x int, y double"), "x", "y", range_rows=10).first()
    frame = pd.DataFrame(rows, columns=["x", "y"]).dropna()
    assert got["n_pairs"] == 1500
    assert math.isclose(got["rank_correlation"], frame["x"].rank().corr(frame["y"].rank()), rel_tol=1e-9)


def test_rank_correlation_without_spread(spark):
    got = rank_correlation(spark.createDataFrame([(1, 2.0), (1, 3.0)], "x int, y double"), "x", "y").first()
    assert got["n_pairs"] == 2 and got["rank_correlation"] is None
    got = rank_correlation(spark.createDataFrame([], "x int, y double"), "x", "y").first()
    assert got["n_pairs"] == 0 and got["rank_correlation"] is None


def test_one_task_only_ever_sees_one_row_per_range(spark):
    df = spark.range(1000).selectExpr("id k", "1L n")
    plan = running_totals(df, ["k"], "n", ranges=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1
    single = plan[plan.index("SinglePartition") :]
    # what meets in one task is the aggregate per range
    assert "HashAggregate(keys=[__t_range" in single
