"""Exact top-k by count through a sketch: equal to counting every key, whatever the distribution."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from vitrine.operators.heavy import frequent_candidates, heavy_hitters


def truth(values, k):
    counts = Counter(values)
    return sorted(counts.items(), key=lambda kv: (-kv[1], kv[0] is None, kv[0]))[:k]


def check(spark, values, k, **params):
    df = spark.createDataFrame([(v, 1) for v in values], "key string, x int").repartition(4)
    found = heavy_hitters(df, "key", k, **params)
    assert [(r["key"], r["count"]) for r in found.top.collect()] == truth(values, k)
    return found


def test_skewed_keys_need_no_third_pass(spark):
    rnd = random.Random(1)
    values = [f"k{min(int(rnd.paretovariate(0.8)), 5000)}" for _ in range(20000)]
    found = check(spark, values, 10, tracked=400)
    assert found.open_buckets == 0 and found.bound < found.kth


def test_as_many_keys_as_rows(spark):
    found = check(spark, [f"k{i}" for i in range(3000)], 50, tracked=64, buckets=128)
    assert found.open_buckets == 128 and found.wider is None


def test_too_narrow_a_sketch_says_so_and_stays_exact(spark):
    rnd = random.Random(2)
    values = [f"k{rnd.randint(0, 400)}" for _ in range(9000)]
    found = check(spark, values, 20, tracked=8, buckets=16)
    assert found.open_buckets > 0 and found.wider is None or found.wider > 8


def test_null_is_a_key_and_ties_go_to_the_smaller(spark):
    values = [None] * 5 + ["a"] * 5 + ["b"] * 5 + ["c"] * 4 + [""] * 2
    for k in (1, 2, 3, 9):
        check(spark, values, k, tracked=2, buckets=4)
        check(spark, values, k)


def test_fewer_keys_than_asked_and_none(spark):
    check(spark, ["a", "a", "b"], 50)
    check(spark, [], 50)
    check(spark, [None], 3)


@pytest.mark.parametrize("fanout", [1, 64])
def test_candidates_hold_the_frequent_keys(spark, fanout):
    values = ["hot"] * 500 + ["warm"] * 200 + [f"k{i}" for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "key string").repartition(7)
    found = {r["key"] for r in frequent_candidates(df, "key", 32, fanout).collect()}
    assert {"hot", "warm"} <= found and len(found) <= 32
