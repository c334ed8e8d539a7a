"""Every registered query equals its DuckDB oracle (sf0.001)."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, duck_connection

SF = "/root/testdata/sf0.001"
# Queries of the optional subpackage have tests of their own.
NAMES = sorted(n for n in queries() if n != "pipeline" and not re.match(r"op\d+_", n))


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    ok, msg = compare(queries()[name](spark, SF), duck, oracle_sql()[name])
    assert ok, msg


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["genre", "nb_games", "sum_positive", "sum_negative", "sum_total_reviews", "positive_rate"]
    assert df.count() > 0


DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}


@pytest.mark.parametrize("name", NAMES)
def test_query_types_match_oracle(spark, duck, name):
    spark_types = {f.name: f.dataType.simpleString() for f in queries()[name](spark, SF).schema.fields}
    rel = duck.sql(oracle_sql()[name])
    duck_types = {c: DUCK_TO_SPARK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types
