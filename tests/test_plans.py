"""Plan checks over every registered query: the physical plans must stay
scale-safe (no pair-emitting joins, no Python in the hot path, partial
aggregation before every shuffle, pruned scans)."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in queries() if n != "pipeline" and not re.match(r"op\d+_", n))
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"]


def _plan(df, capsys) -> str:
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", NAMES)
def test_plan_is_scale_safe(spark, capsys, name):
    plan = _plan(queries()[name](spark, SF), capsys)
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op} in plan"
    # every final aggregate (with aggregate functions) has a partial phase;
    # a DISTINCT (no functions) is partial by construction
    finals = len(re.findall(r"HashAggregate\(keys=\[[^\]]*\], functions=\[(?!partial_)(?!merge_)(?!\])", plan))
    partials = len(re.findall(r"functions=\[partial_", plan)) + len(re.findall(r"functions=\[merge_", plan))
    if finals:
        assert partials >= 1, f"{name}: aggregate without a partial phase"


def test_report_scans_read_only_needed_columns(spark, capsys):
    plan = _plan(queries()["genre_reviews"](spark, SF), capsys)
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas, plan
    for schema in schemas:
        for unused in ("release_date_raw", "owners_raw", "developer", "languages_raw"):
            assert unused not in schema, schema


def test_reports_read_the_tables_and_only_those_they_need(spark, capsys):
    plan = _plan(queries()["age_distribution"](spark, SF), capsys)
    assert "orders.parquet" in plan and "customer.parquet" in plan
    assert "lineitem.parquet" not in plan


def test_no_window_over_all_rows(spark, capsys):
    plan = _plan(queries()["ext_genre_share"](spark, SF), capsys)
    assert "Window" not in plan
    assert "Expand" not in plan or "lineitem" not in plan


def test_rows_added_to_the_tables_are_seen(spark, tmp_path):
    for name in ("orders", "customer", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    total = lambda: queries()["catalog_totals"](spark, str(tmp_path)).first()["n_rows"]
    before = total()
    spark.read.parquet(f"{SF}/orders.parquet").write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    assert total() == 2 * before
