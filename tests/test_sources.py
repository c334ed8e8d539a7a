"""JSON source (explicit and inferred schema), schema reports, Parquet sink."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vitrine.operators.flatten import FLAT_MAPPING, flatten_catalog
from vitrine.plans.pipeline import build_catalog, build_silver, catalog_from_json
from vitrine.sources.catalog import silver_extremes
from vitrine.sources import (
    CATALOG_SCHEMA,
    EXPECTED_COLUMNS,
    check_columns,
    read_catalog,
    read_silver,
    schema_json,
    schema_report,
    schema_rows,
)

RECORDS = [
    {
        "id": "1",
        "data": {
            "appid": 1, "name": "Alpha", "genre": "Action, Indie", "publisher": "P", "developer": "D",
            "type": "game", "price": "999", "initialprice": "1999", "discount": "50", "required_age": 0,
            "positive": 90, "negative": 10, "languages": "English, French", "owners": "0 .. 20,000", "ccu": 5,
            "platforms": {"linux": False, "mac": True, "windows": True}, "release_date": "Oct 21, 2008",
        },
    },
    {
        "id": "2",
        "data": {
            "appid": 2, "name": "Beta", "genre": "RPG", "price": "0", "required_age": "17+",
            "positive": None, "negative": 3, "platforms": {"linux": True, "mac": True, "windows": True},
            "release_date": "2000/11/1",
        },
    },
    {"id": "3", "data": {"appid": 3, "price": 12.5, "release_date": "coming soon"}},
]
BROKEN = '{"id": "4", "data": {"appid": 4, "name": "Broken"'


def _write_fixture(folder) -> str:
    path = folder / "catalog.json"
    lines = [json.dumps(r) for r in RECORDS] + [BROKEN]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_json_explicit_schema(spark, tmp_path):
    path = _write_fixture(tmp_path)
    raw = read_catalog(spark, path)
    assert raw.schema == CATALOG_SCHEMA
    assert raw.count() == 4
    flat = flatten_catalog(raw)
    rows = {r.id: r for r in flat.collect()}
    assert rows["1"].price_raw == "999" and rows["1"].required_age_raw == "0"
    assert rows["2"].price_raw == "0" and rows["2"].required_age_raw == "17+" and rows["2"].positive_raw is None
    assert rows["3"].name is None and rows["3"].genre_raw is None and rows["3"].platform_windows is None
    assert rows["3"].price_raw == "12.5"
    # NULL counts as a value for a distinct projection, not for count_distinct
    assert raw.select("data.name").distinct().count() == 3
    assert raw.agg(F.count_distinct("data.name")).first()[0] == 2


def test_json_corrupt_column(spark, tmp_path):
    path = _write_fixture(tmp_path)
    raw = read_catalog(spark, path, corrupt_column="_corrupt_record").cache()
    bad = raw.filter(F.col("_corrupt_record").isNotNull()).collect()
    assert len(bad) == 1 and bad[0]._corrupt_record == BROKEN
    raw.unpersist()


def test_json_inferred_schema(spark, tmp_path):
    path = _write_fixture(tmp_path)
    raw = read_catalog(spark, path, schema=None)
    data_type = dict((f.name, f.dataType.simpleString()) for f in raw.schema["data"].dataType.fields)
    assert data_type["price"] == "string"
    assert data_type["required_age"] == "string"
    assert "_corrupt_record" in raw.columns


def test_catalog_from_json(spark, tmp_path):
    path = _write_fixture(tmp_path)
    cat = catalog_from_json(spark, path)
    assert check_columns(cat) == []
    rows = {r.id: r for r in cat.collect() if r.id is not None}
    a = rows["1"]
    assert (a.price, a.price_eur, a.discount, a.required_age) == (999.0, 9.99, 50.0, 0)
    assert (a.release_year, a.release_month, a.covid_period) == (2008, 10, "pre_covid")
    assert (a.total_reviews, a.positive_ratio, a.num_languages) == (100, 0.9, 2)
    assert a.platform_profile == "Windows + macOS"
    b = rows["2"]
    assert (b.price, b.required_age, b.total_reviews, b.positive_ratio) == (0.0, 17, None, None)
    assert str(b.release_date_parsed) == "2000-11-01"
    assert b.platform_profile == "Windows + macOS + Linux"
    c = rows["3"]
    assert (c.price, c.release_date_parsed, c.covid_period, c.platform_profile) == (12.5, None, "unknown", "Others")


def test_schema_report(spark, catalog):
    rows = schema_rows(CATALOG_SCHEMA)
    paths = [p for p, _, _ in rows]
    assert "data.platforms.windows" in paths and ("data.price", "string", True) in rows
    report = schema_report(spark, catalog)
    assert report.count() == len(schema_rows(catalog.schema))
    assert set(EXPECTED_COLUMNS) <= set(r.path for r in report.collect())
    assert json.loads(schema_json(catalog))["type"] == "struct"
    assert schema_json(catalog, indent=2).startswith("{\n")


def test_check_columns(spark, catalog):
    flat_only = catalog.select(*FLAT_MAPPING)
    missing = check_columns(flat_only)
    assert "price" in missing and "covid_period" in missing and "id" not in missing
    try:
        check_columns(flat_only, strict=True)
    except ValueError as exc:
        assert "price" in str(exc)
    else:  # pragma: no cover
        raise AssertionError("strict check did not raise")


def test_silver_round_trip(spark, catalog, tmp_path, capsys):
    path = str(tmp_path / "silver")
    build_silver(catalog.drop("languages_array", "genre_array"), path)
    silver = read_silver(spark, path)
    assert silver.count() == catalog.count()
    # the period report reads only the matching year partitions
    silver.filter(F.col("release_year") == 1996).explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(release_year" in plan
    left = catalog.select("app_id", "price", "release_year").exceptAll(silver.select("app_id", "price", "release_year"))
    assert left.count() == 0
    # rebalanced write: one file per year partition at this size, not one per (task, year)
    years = silver.select("release_year").distinct().count()
    assert len(silver.inputFiles()) <= years + 1


def test_build_catalog_from_raw_table(spark):
    from vitrine.sources.catalog import catalog_from_tables

    raw = catalog_from_tables(spark, "/root/testdata/sf0.001")
    # The same fields; counts and ids are text in JSON and typed in the tables.
    assert raw.schema["data"].dataType.fieldNames() == CATALOG_SCHEMA["data"].dataType.fieldNames()
    assert build_catalog(raw).count() == 1500


def test_quoted_and_decimal_counts_survive(spark, tmp_path):
    path = tmp_path / "counts.json"
    values = [("1", 1, 90, 10), ("2", "2", "90", "10"), ("3", 3.0, 90.0, "10.0"), ("4", "x", "12.7", None)]
    path.write_text("".join(json.dumps({"id": i, "data": {"appid": a, "positive": p, "negative": n, "ccu": p}}) + "\n" for i, a, p, n in values))
    rows = {r.id: r for r in build_catalog(read_catalog(spark, str(path))).collect()}
    for i in ("1", "2", "3"):
        assert (rows[i].app_id, rows[i].positive, rows[i].negative, rows[i].total_reviews, rows[i].ccu) == (int(i), 90, 10, 100, 90)
    assert (rows["4"].app_id, rows["4"].positive, rows["4"].total_reviews) == (None, None, None)


def test_huge_numbers_never_raise(spark, ansi):
    from vitrine.operators.features import with_review_features
    from vitrine.operators.stats import histogram

    df = spark.createDataFrame([(x,) for x in (1e30, float("inf"), float("nan"), -1e30, 750.0, None)], "price double")
    assert {r.bucket: r["count"] for r in histogram(df, "price", 500).collect()} == {500: 1, None: 4}
    big = spark.createDataFrame([((1 << 63) - 1, 1), (9, 1)], "positive long, negative long")
    assert [r.total_reviews for r in with_review_features(big).collect()] == [None, 10]


def test_counts_and_extremes_come_from_footers(spark, catalog, tmp_path):
    path = str(tmp_path / "silver")
    build_silver(catalog.select("app_id", "price", "total_reviews", "release_year"), path)
    for partition in ("release_year", None):
        found = silver_extremes(spark, path, ["price", "total_reviews"], partition)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [COUNT(*)" in plan
        keys = [partition] if partition else []
        want = catalog.groupBy(*keys).agg(
            F.count(F.lit(1)), *[f(c) for c in ("price", "total_reviews") for f in (F.count, F.min, F.max)]
        )
        assert sorted(map(lambda r: str(tuple(r)), found.collect())) == sorted(map(lambda r: str(tuple(r)), want.collect()))
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
