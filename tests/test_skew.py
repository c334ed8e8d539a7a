"""A customer owning a third of all orders: the shuffled customer join is
split by AQE's skew handling and the catalog is unchanged."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.plans.pipeline import build_catalog
from vitrine.sources.catalog import catalog_from_frames

N_ORDERS = 30000


def _frames(spark):
    o = spark.range(N_ORDERS).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997 + 1).alias("o_custkey"),
        (F.col("id") % 500 * 37.5 + 1000).alias("o_totalprice"),
        F.expr("to_timestamp_ntz(date_add(date'1995-01-01', cast(id % 2400 as int)))").alias("o_orderdate"),
        F.concat(F.lit("P"), (F.col("id") % 5).cast("string")).alias("o_orderpriority"),
    )
    c = spark.range(998).select(
        F.col("id").alias("c_custkey"),
        F.concat(F.lit("Customer#"), F.col("id").cast("string")).alias("c_name"),
        F.element_at(F.array(*[F.lit(s) for s in ("A", "B", "C", "D")]), (F.col("id") % 4 + 1).cast("int")).alias(
            "c_mktsegment"
        ),
    )
    li = spark.range(N_ORDERS * 3).select(
        (F.col("id") % N_ORDERS).alias("l_orderkey"),
        (F.col("id") % 7 + 1).cast("double").alias("l_quantity"),
        F.when(F.col("id") % 4 == 0, F.lit("R")).otherwise(F.lit("N")).alias("l_returnflag"),
    )
    return o, c, li


def _summary(df):
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total_reviews").alias("reviews"),
        F.count_distinct("publisher").alias("publishers"),
        F.bit_xor(F.xxhash64("app_id", "genre_raw", "price", "release_date_parsed")).alias("h"),
    ).first()


def test_skewed_customer_join_is_split(spark, capsys):
    o, c, li = _frames(spark)
    expected = _summary(build_catalog(catalog_from_frames(o, c, li)))

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",  # force a shuffled join
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        catalog = build_catalog(catalog_from_frames(o, c, li))
        assert _summary(catalog) == expected
        catalog.collect()
        catalog.explain()
        plan = capsys.readouterr().out
        assert "isFinalPlan=true" in plan
        assert "SortMergeJoin" in plan and "skew=true" in plan
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
