"""Distributed exact quantiles equal Spark's exact aggregates."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
NAMES = [f"q{i}" for i in range(len(PROBS))]


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(20000):
        g = "hot" if i % 3 else f"g{i % 11}"  # one group holds two thirds of the rows
        v = rnd.choice([round(rnd.random() * 1000, 2), float(rnd.randint(0, 9)), None])
        rows.append((g, v))
    rows += [(None, 5.0), (None, 7.0), ("single", 3.0), ("only_nulls", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(4)


def _builtin(df, discrete, groups):
    if discrete:
        cols = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)").alias(n) for p, n in zip(PROBS, NAMES)]
    else:
        cols = [F.percentile("v", F.lit(p)).alias(n) for p, n in zip(PROBS, NAMES)]
    out = df.groupBy(*groups).agg(*cols) if groups else df.agg(*cols)
    return {tuple(r[g] for g in groups): tuple(r[n] for n in NAMES) for r in out.collect() if r[NAMES[0]] is not None}


def _ours(df, discrete, groups, **kw):
    out = exact_quantiles(df, "v", PROBS, NAMES, groups, discrete=discrete, **kw).collect()
    return {tuple(r[g] for g in groups): tuple(r[n] for n in NAMES) for r in out}


@pytest.mark.parametrize("discrete", [False, True], ids=["cont", "disc"])
@pytest.mark.parametrize("groups", [["g"], []], ids=["grouped", "global"])
def test_matches_builtin(skewed, discrete, groups):
    assert _ours(skewed, discrete, groups, sketch_k=200) == _builtin(skewed, discrete, groups)


@pytest.mark.parametrize("discrete", [False, True], ids=["cont", "disc"])
@pytest.mark.parametrize("many", [False, True], ids=["broadcast", "shuffled"])
def test_exact_whatever_the_cuts(skewed, discrete, many):
    """Poor cut points, and groups above the broadcast limit, change no result."""
    kw = {"sketch_k": 8, "bracket_margin": 0.0, "broadcast_groups": 0 if many else 1000}
    assert _ours(skewed, discrete, ["g"], **kw) == _builtin(skewed, discrete, ["g"])


@pytest.mark.parametrize("groups", [["g"], []], ids=["grouped", "global"])
def test_plan_shuffles_no_raw_rows(spark, skewed, groups, capsys):
    """Every exchange follows a partial aggregate, also where the planner may broadcast nothing by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exact_quantiles(skewed, "v", [0.25, 0.5], ["a", "b"], groups).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert "partial_percentile" not in plan and "SortMergeJoin" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("discrete", [False, True], ids=["cont", "disc"])
def test_nan_is_the_largest_value(spark, discrete):
    nan = float("nan")
    rows = [("all", nan), ("all", nan), ("most", 1.0), ("most", nan), ("most", nan), ("few", 1.0), ("few", 2.0), ("few", nan)]
    df = spark.createDataFrame(rows, "g string, v double")
    for groups in (["g"], []):
        assert str(_ours(df, discrete, groups)) == str({k: _builtin(df, discrete, groups)[k] for k in _ours(df, discrete, groups)})


def test_empty_and_validation(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(empty, "v", [0.5], ["m"], ["g"]).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(empty, "v", [1.5], ["m"])
    with pytest.raises(ValueError):
        exact_quantiles(empty, "v", [0.5], ["a", "b"])


def test_infinite_and_constant_values(spark):
    rows = [("a", float("-inf")), ("a", 1.0), ("a", 2.0), ("a", float("inf")), ("b", 5.0), ("b", 5.0), ("b", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for discrete in (False, True):
        assert _ours(df, discrete, ["g"], sketch_k=8) == {
            k: v for k, v in _builtin(df, discrete, ["g"]).items()
        }


def test_counts_and_means_from_the_counting_pass(spark, monkeypatch):
    from vitrine.operators import quantiles

    rows = [(g, v) for g in ("a", "b", None) for v in (1.0, 2.0, 2.0, 7.5, None)] + [("empty", None)] * 3
    df = spark.createDataFrame(rows, "g string, v double")
    for groups_sent in (10, 0):
        got = exact_quantiles(df, "v", [0.5], ["m"], ["g"], broadcast_groups=groups_sent, count_col="n", mean_col="avg")
        found = {r["g"]: (r["n"], r["avg"], r["m"]) for r in got.collect()}
        assert found == {"a": (5, 3.125, 2.0), "b": (5, 3.125, 2.0), None: (5, 3.125, 2.0), "empty": (3, None, None)}
    # the rows are read for the cuts, the counts and the values: each scan of the source is one of three jobs
    reads = []
    keep = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda d, name, *a: reads.append(d._jdf.queryExecution().executedPlan().toString()) or keep(d, name, *a))
    last = exact_quantiles(df, "v", [0.5], ["m"], ["g"], count_col="n", mean_col="avg")
    plans = [*reads, last._jdf.queryExecution().executedPlan().toString()]
    assert len(plans) == 3 and [p.count("Scan ExistingRDD") for p in plans] == [1, 1, 1]
