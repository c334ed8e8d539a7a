"""Catalog sources and sinks.

* :func:`read_catalog` — distributed read of line-delimited nested JSON.
* :func:`write_catalog` / :func:`read_silver` — the typed Parquet table that
  every report reads instead of re-parsing JSON.
* :func:`catalog_from_tables` — the raw nested catalog derived from the
  ``orders`` / ``customer`` / ``lineitem`` tables, one record per order.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import CATALOG_SCHEMA


def read_catalog(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = CATALOG_SCHEMA,
    corrupt_column: str | None = None,
) -> DataFrame:
    """Read one JSON object per line.

    With ``schema`` (default) there is no inference pass and type conflicts
    in a field resolve to NULL for that record. ``schema=None`` infers the
    schema from the data (one extra full pass). ``corrupt_column`` keeps the
    text of lines that cannot be parsed.
    """
    reader = spark.read.option("mode", "PERMISSIVE")
    if schema is not None:
        if corrupt_column:
            schema = T.StructType(schema.fields + [T.StructField(corrupt_column, T.StringType())])
            reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
        reader = reader.schema(schema)
    elif corrupt_column:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.json(path)


def write_catalog(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
    rebalance: bool = True,
) -> None:
    """Write the prepared product table as Parquet.

    Partitioning by a low-cardinality column (``release_year``) lets period
    reports prune files. With ``rebalance`` the rows are first clustered by
    the partition column with Spark's ``REBALANCE`` hint: AQE splits a skewed
    value (a year holding a third of the catalog becomes many files of about
    the advisory size) and merges small ones, so the table gets a bounded
    number of well-sized files instead of one file per (task, year).
    ``rebalance=False`` skips that shuffle and only sorts inside each task.
    """
    writer = df
    if partition_by:
        writer = df.hint("rebalance", *partition_by) if rebalance else df.sortWithinPartitions(*partition_by)
    w = writer.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by :func:`write_catalog`."""
    return spark.read.parquet(path)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _case_mod(key: Column, cases: list[tuple[int, Column]], default: Column) -> Column:
    """``CASE WHEN key % m = 0 THEN v ... ELSE default END`` in list order."""
    expr = None
    for modulus, value in cases:
        cond = key % modulus == 0
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default) if expr is not None else default


def catalog_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw nested catalog (``id`` + struct ``data``) built from the TPC-H-ish
    tables of ``sf_dir``: one product per order, review counts from its line
    items (see :func:`catalog_from_frames`)."""
    return catalog_from_frames(
        load_table(spark, sf_dir, "orders"),
        load_table(spark, sf_dir, "customer"),
        load_table(spark, sf_dir, "lineitem"),
    )


def catalog_from_frames(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Raw nested catalog from orders / customer / line-item frames.

    Plan: line items are pre-aggregated per order (partial aggregation before
    the shuffle), the result is hash-partitioned on the order key and joined
    to orders on that key; customers are joined on the customer key. Join
    strategies are left to AQE: a side is broadcast only when its measured
    size is under ``spark.sql.autoBroadcastJoinThreshold``, skewed partitions
    of a shuffled join (one customer with a third of the orders) are split.
    """
    orders = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = customer.select("c_custkey", "c_name", "c_mktsegment")
    returned = F.col("l_returnflag") == "R"
    reviews = (
        lineitem
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.when(~returned, F.col("l_quantity")).otherwise(F.lit(0.0))).cast("bigint").alias("pos"),
            F.sum(F.when(returned, F.col("l_quantity")).otherwise(F.lit(0.0))).cast("bigint").alias("neg"),
        )
    )
    # Orders are hash-partitioned on the order key: this is the exchange the
    # join with the per-order aggregate (already partitioned on that key)
    # needs at scale, so it costs no extra shuffle there, and it spreads the
    # per-product feature work over all tasks even when the source is one
    # file with one row group.
    joined = (
        orders.repartition("o_orderkey")
        .join(reviews, orders.o_orderkey == reviews.l_orderkey, "left")
        .join(customer, orders.o_custkey == customer.c_custkey, "inner")
    )

    k = F.col("o_orderkey")
    seg, prio = F.col("c_mktsegment"), F.col("o_orderpriority")
    null_str = F.lit(None).cast("string")
    genre = _case_mod(
        k,
        [(97, null_str), (89, F.lit("")), (7, F.concat(seg, F.lit(","), prio, F.lit(", "), seg, F.lit(",")))],
        F.concat(seg, F.lit(", "), prio),
    )
    price = _case_mod(
        k,
        [(101, F.lit("n/a")), (13, F.lit("0"))],
        F.round(F.col("o_totalprice") / 100).cast("bigint").cast("string"),
    )
    initialprice = _case_mod(
        k, [(101, F.lit("n/a"))], F.round(F.col("o_totalprice") / 90).cast("bigint").cast("string")
    )
    discount = F.when(k % 3 == 0, (k % 9 * 10).cast("string")).otherwise(F.lit("0"))
    age_mod = k % 11
    required_age = (
        F.when(age_mod == 0, F.lit("17+"))
        .when(age_mod == 1, F.lit("MA 18"))
        .when(age_mod == 2, F.lit("PEGI"))
        .when(age_mod == 3, null_str)
        .otherwise(F.lit("0"))
    )
    languages = _case_mod(
        k,
        [(53, null_str), (59, F.lit("")), (4, F.lit("English, French, German")), (2, F.lit("English, French"))],
        F.lit("English"),
    )
    date_mod = k % 6
    release_date = (
        F.when(date_mod == 0, F.date_format("o_orderdate", "MMM d, yyyy"))
        .when(date_mod == 1, F.date_format("o_orderdate", "d MMM, yyyy"))
        .when(date_mod == 2, F.date_format("o_orderdate", "yyyy/M/d"))
        .when(date_mod == 3, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(date_mod == 4, F.lit("coming soon"))
        .otherwise(F.lit(""))
    )
    platforms = F.struct(
        (k % 5 == 0).alias("linux"),
        (k % 4 == 0).alias("mac"),
        F.when(k % 61 == 0, F.lit(None).cast("boolean")).otherwise(k % 50 != 0).alias("windows"),
    )
    data = F.struct(
        k.alias("appid"),
        F.concat(F.lit("item "), k.cast("string")).alias("name"),
        genre.alias("genre"),
        F.when(k % 83 == 0, null_str).otherwise(F.col("c_name")).alias("publisher"),
        F.col("c_name").alias("developer"),
        F.when(k % 10 == 0, F.lit("dlc")).otherwise(F.lit("item")).alias("type"),
        price.alias("price"),
        initialprice.alias("initialprice"),
        discount.alias("discount"),
        required_age.alias("required_age"),
        F.col("pos").alias("positive"),
        F.col("neg").alias("negative"),
        languages.alias("languages"),
        F.when(k % 5 == 0, F.lit("20,000 .. 50,000")).otherwise(F.lit("0 .. 20,000")).alias("owners"),
        (k % 1000).alias("ccu"),
        platforms.alias("platforms"),
        release_date.alias("release_date"),
    )
    return joined.select(k.cast("string").alias("id"), data.alias("data"))


def read_with_footers(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose counts, minima and maxima (whole or per partition value) are taken from file footers: the
    second-version source pushes such aggregates down. Settings are those of a session of its own."""
    own = spark.newSession()
    for key in spark.conf.getAll:
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, spark.conf.get(key))
    listed = own.conf.get("spark.sql.sources.useV1SourceList").split(",")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in listed if s != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path)


def silver_extremes(spark: SparkSession, path: str, columns: list[str], partition: str | None = "release_year") -> DataFrame:
    """Rows, and for each of ``columns`` its values, minimum and maximum, per partition value (or of the whole table with
    None), without reading a column. Columns must be of a type whose footers are exact: numbers, dates, booleans."""
    table = read_with_footers(spark, path)
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        aggregates += [F.count(c).alias(f"n_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    found = table.groupBy(partition).agg(*aggregates) if partition else table.agg(*aggregates)
    # a footer writes the minimum zero as minus zero
    zeros = {
        f"{end}_{c}": F.col(f"{end}_{c}") + F.lit(0.0)
        for c in columns for end in ("min", "max") if table.schema[c].dataType.typeName() in ("double", "float")
    }
    return found.withColumns(zeros)
