"""From raw records to the product table and its genre bridge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.labels import PERIOD_END, PERIOD_START
from ..operators.explode import explode_tokens
from ..operators.features import prepare_catalog
from ..operators.flatten import flatten_catalog
from ..session import materialize
from ..sources.catalog import catalog_from_tables, read_catalog, write_catalog


def build_catalog(
    raw: DataFrame,
    period_start: int = PERIOD_START,
    period_end: int = PERIOD_END,
    date_formats: list[str] | None = None,
) -> DataFrame:
    """Raw nested records → flat, typed, feature-complete product table."""
    return prepare_catalog(flatten_catalog(raw), period_start, period_end, date_formats)


def catalog_from_json(spark: SparkSession, path: str, **params) -> DataFrame:
    """Product table straight from line-delimited JSON (explicit schema)."""
    return build_catalog(read_catalog(spark, path), **params)


def catalog_for(spark: SparkSession, sf_dir: str, **params) -> DataFrame:
    """Product table derived from the TPC-H-ish tables of ``sf_dir``."""
    return build_catalog(catalog_from_tables(spark, sf_dir), **params)


def genres_of(catalog: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Bridge table, one row per (product, genre)."""
    return explode_tokens(catalog, "genre_array", "genre", keep)


def build_silver(catalog: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Persist the product table as Parquet (partitioned by release year by
    default) so reports get column pruning, pushdown and partition pruning
    instead of re-parsing JSON."""
    write_catalog(catalog, path, partition_by=["release_year"] if partition_by is None else partition_by)


def checkpointed_catalog(catalog: DataFrame) -> DataFrame:
    """Write the product table to the session's shared folder and read it
    back: several reports then share one computation, and a lost executor
    costs a re-read instead of a recompute from the raw source."""
    return materialize(catalog, "catalog")
