"""Schema of the raw catalog, the expected flat columns, and schema reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Explicit schema of one raw catalog record ``{id, data: {...}}``.
# Numbers are read as strings and typed later with ``try_cast``: sources mix
# 90, "90" and 90.0, and a malformed value becomes NULL instead of failing the
# read or nulling its neighbours.
PLATFORMS_TYPE = T.StructType(
    [
        T.StructField("linux", T.BooleanType()),
        T.StructField("mac", T.BooleanType()),
        T.StructField("windows", T.BooleanType()),
    ]
)

DATA_TYPE = T.StructType(
    [
        T.StructField("appid", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("genre", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("developer", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("price", T.StringType()),
        T.StructField("initialprice", T.StringType()),
        T.StructField("discount", T.StringType()),
        T.StructField("required_age", T.StringType()),
        T.StructField("positive", T.StringType()),
        T.StructField("negative", T.StringType()),
        T.StructField("languages", T.StringType()),
        T.StructField("owners", T.StringType()),
        T.StructField("ccu", T.StringType()),
        T.StructField("platforms", PLATFORMS_TYPE),
        T.StructField("release_date", T.StringType()),
    ]
)

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("data", DATA_TYPE),
    ]
)

# The columns the prepared product table is expected to carry,
# in the order the analysis lists them.
EXPECTED_COLUMNS = [
    "id", "app_id", "name", "genre_raw", "publisher", "developer", "type",
    "price", "initialprice", "discount",
    "required_age_str", "required_age",
    "positive", "negative", "total_reviews", "positive_ratio",
    "languages_raw", "owners_raw", "ccu",
    "platform_windows", "platform_mac", "platform_linux",
    "release_date_raw", "release_date_parsed", "release_year", "release_month", "covid_period",
]


def schema_json(df: DataFrame, indent: int | None = None) -> str:
    """Full nested schema as JSON text, compact or indented."""
    if indent is None:
        return df.schema.json()
    return json.dumps(df.schema.jsonValue(), indent=indent)


def _walk(dtype: T.DataType, prefix: str, nullable: bool, out: list[tuple[str, str, bool]]) -> None:
    out.append((prefix, dtype.simpleString(), nullable))
    if isinstance(dtype, T.StructType):
        for field in dtype.fields:
            _walk(field.dataType, f"{prefix}.{field.name}", field.nullable, out)
    elif isinstance(dtype, T.ArrayType):
        _walk(dtype.elementType, f"{prefix}[]", dtype.containsNull, out)
    elif isinstance(dtype, T.MapType):
        _walk(dtype.keyType, f"{prefix}{{key}}", False, out)
        _walk(dtype.valueType, f"{prefix}{{value}}", dtype.valueContainsNull, out)


def schema_rows(schema: T.StructType) -> list[tuple[str, str, bool]]:
    """Every path of a (nested) schema with its type and nullability."""
    out: list[tuple[str, str, bool]] = []
    for field in schema.fields:
        _walk(field.dataType, field.name, field.nullable, out)
    return out


def schema_report(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Schema of ``df`` as a small relation (path, type, nullable).

    The schema is plan metadata held by the driver already, so this builds a
    tiny local relation; no data is read.
    """
    return spark.createDataFrame(
        schema_rows(df.schema), "path string, type string, nullable boolean"
    )


def check_columns(df: DataFrame, expected: list[str] | None = None, strict: bool = False) -> list[str]:
    """Return the expected columns that ``df`` lacks; raise when ``strict``."""
    expected = EXPECTED_COLUMNS if expected is None else expected
    present = set(df.columns)
    missing = [c for c in expected if c not in present]
    if strict and missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return missing
