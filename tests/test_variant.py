"""VARIANT scan: mixed types, unknown fields, broken lines, one read."""

from __future__ import annotations

import json

from vitrine.operators.features import prepare_catalog
from vitrine.operators.flatten import flatten_catalog
from vitrine.plans.pipeline import build_catalog
from vitrine.sources import read_catalog
from vitrine.sources.variant import (
    field_types, file_fields, file_fingerprints, files_without, merged_fields, read_variant, variant_records, variant_schema,
)

RECORDS = [
    {"id": "1", "data": {"appid": 1, "price": 90, "platforms": {"linux": "true", "mac": False, "console": 1}, "new": [1, {"a": 2}]}},
    {"id": 2, "data": {"appid": "2", "price": "90", "positive": "x", "negative": 3.0, "platforms": "none"}, "origin": "feed"},
    {"id": "3", "data": {"appid": 3, "price": 90.5, "name": None, "genre": "Action, Indie", "release_date": "2000/11/1"}},
    {"id": "4"},
    {"id": "5", "data": None},
]
BROKEN = ['{"id": "6", "data": {"appid"', "[1, 2]", "text", "7"]


def source(folder, extra=()):
    path = folder / "lines.json"
    path.write_text("\n".join([*map(json.dumps, RECORDS), "", *BROKEN, "   ", *extra]) + "\n")
    return str(path)


def test_fields_extras_and_broken_lines(spark, tmp_path):
    rows = variant_records(read_variant(spark, source(tmp_path))).collect()
    found = {r["id"]: r for r in rows if r["broken"] is None}
    assert sorted(r["broken"] for r in rows if r["broken"] is not None) == sorted(BROKEN)
    assert set(found) == {"1", "2", "3", "4", "5"}
    assert [found[i]["data"]["price"] for i in "123"] == ["90", "90", "90.5"]
    assert found["1"]["data"]["platforms"]["linux"] is True and found["1"]["data"]["platforms"]["mac"] is False
    assert json.loads(found["1"]["extras"]) == {"data.platforms.console": 1, "data.new": [1, {"a": 2}]}
    # an object that is text is no object, but it is not lost either
    assert json.loads(found["2"]["extras"]) == {"origin": "feed", "data.platforms": "none"}
    assert found["3"]["extras"] is None and found["4"]["extras"] is None and found["5"]["extras"] is None
    assert all(r["extras"] is None and r["id"] is None for r in rows if r["broken"] is not None)


def test_same_products_as_the_schema_scan(spark, tmp_path, ansi):
    path = source(tmp_path)
    columns = ["id", "app_id", "price", "positive", "negative", "platform_linux", "release_year"]
    variant = variant_records(read_variant(spark, path))
    typed = prepare_catalog(flatten_catalog(variant, keep=["broken"])).filter("broken IS NULL and id <> '2'").select(*columns)
    plain = build_catalog(read_catalog(spark, path)).filter("id IN ('1', '3', '4', '5')").select(*columns)
    # record 1 has text where the schema scan wants a boolean, which it reads as NULL
    differ = lambda df: sorted(map(str, df.drop("platform_linux").collect()))
    assert differ(typed) == differ(plain)


def test_one_read_of_the_source(spark, tmp_path):
    df = variant_records(read_variant(spark, source(tmp_path)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and plan.lower().count("parse_json") <= 1


def test_a_record_is_read_at_once_and_copied_only_for_extras(spark, tmp_path):
    df = variant_records(read_variant(spark, source(tmp_path)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "$['data']['price']" not in plan and "schema_of_variant(parsed" not in plan


def test_extras_of_odd_records(spark, tmp_path):
    odd = ['{}', '{"id": null, "data": {"platforms": null, "name": {"a": 1}}}', '{"data": [1], "id": [2]}', '{"data": {"appid": {}, "x": {}}}']
    rows = variant_records(read_variant(spark, source(tmp_path, odd))).filter("broken IS NULL").collect()
    empty, nulls, wrong, inner = rows[-4:]
    assert empty["id"] is None and empty["data"]["platforms"]["linux"] is None and empty["extras"] is None
    assert nulls["data"]["name"] == '{"a":1}' and nulls["extras"] is None
    assert wrong["id"] == "[2]" and wrong["data"]["appid"] is None and json.loads(wrong["extras"]) == {"data": [1]}
    assert inner["data"]["appid"] == "{}" and json.loads(inner["extras"]) == {"data.x": {}}


def test_field_types_copy_no_values(spark, tmp_path):
    odd = ['{}', '{"a": {}, "b": {"c": {"d": 1}, "e": [1.5]}, "f": null, "g": {"h": null}}']
    df = field_types(read_variant(spark, source(tmp_path, odd)))
    assert "MapType(StringType,VariantType" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["path"], r["type"]): r["n_records"] for r in df.collect()}
    want = {("a", "OBJECT"), ("b", "OBJECT"), ("b.c", "OBJECT"), ("b.e", "ARRAY"), ("f", "VOID"), ("g", "OBJECT"), ("g.h", "VOID")}
    assert all(got[x] == 1 for x in want) and got["data", "VOID"] == 1
    assert {x for x in got if x[0][0] in "abefg"} == want
    keyed = field_types(read_variant(spark, source(tmp_path, odd)).selectExpr("record", "1 AS pos", "2 AS value"), keys=["pos", "value"])
    assert {(r["path"], r["type"]): r["n_records"] for r in keyed.filter("pos = 1 AND value = 2").collect()} == got


def test_field_types(spark, tmp_path):
    got = {(r["path"], r["type"]): r["n_records"] for r in field_types(read_variant(spark, source(tmp_path))).collect()}
    assert got["id", "STRING"] == 4 and got["id", "BIGINT"] == 1
    assert got["data.price", "BIGINT"] == 1 and got["data.price", "STRING"] == 1 and got["data.price", "DECIMAL"] == 1
    assert got["data", "OBJECT"] == 3 and got["data.platforms", "STRING"] == 1 and got["origin", "STRING"] == 1


def test_schema_of_the_source(spark, tmp_path):
    path = tmp_path / "plain.json"
    path.write_text('{"id": 1, "x": "a"}\n{"id": 2, "y": [1]}\n')
    schema = variant_schema(read_variant(spark, str(path))).first()["schema"]
    assert schema == "OBJECT<id: BIGINT, x: STRING, y: ARRAY<BIGINT>>"
    empty = tmp_path / "empty.json"
    empty.write_text("")
    assert variant_records(read_variant(spark, str(empty))).count() == 0


def drift_folder(folder):
    layouts = {
        "a.json": [{"id": 1, "data": {"price": 1, "name": "x"}}, {"id": 2, "data": {"price": None}}],
        "b.json": [{"id": 3, "data": {"price": 1.5, "name": "y"}, "tags": ["t"]}],
        "c.json": [{"id": "4", "data": {"price": "6", "name": "z"}, "tags": "t"}, {"id": "5"}],
        "d.json": [{"id": 6, "data": {"price": 2, "name": "w"}}],
    }
    for name, records in layouts.items():
        (folder / name).write_text("\n".join(map(json.dumps, records)) + "\nbroken {\n")
    return str(folder)


def test_drift_across_files(spark, tmp_path):
    fields = file_fields(spark, drift_folder(tmp_path)).cache()
    prints = {r["file"].rsplit("/", 1)[1]: (r["fingerprint"], r["n_fields"]) for r in file_fingerprints(fields).collect()}
    assert set(prints) == {"a.json", "b.json", "c.json", "d.json"} and len(set(prints.values())) == 4
    merged = {r["path"]: (r["type"], r["n_files"]) for r in merged_fields(fields).collect()}
    assert merged == {
        "id": ("STRING", 4), "data": ("OBJECT", 4), "data.price": ("STRING", 4), "data.name": ("STRING", 4), "tags": ("VARIANT", 2),
    }
    numbers = merged_fields(fields.filter("file not like '%c.json'")).collect()
    assert {r["path"]: r["type"] for r in numbers}["data.price"] == "DECIMAL"
    missing = sorted((r["file"].rsplit("/", 1)[1], r["path"]) for r in files_without(fields, ["id", "tags", "data.genre"]).collect())
    assert missing == [("a.json", "data.genre"), ("a.json", "tags"), ("b.json", "data.genre"), ("c.json", "data.genre"), ("d.json", "data.genre"), ("d.json", "tags")]
    assert files_without(fields, []).count() == 0
    fields.unpersist()
