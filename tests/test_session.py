"""Session helpers: partition sizing, shared folder, materialization."""

from __future__ import annotations

from vitrine.session import MB, materialize, scale_conf, shared_dir


def test_scale_conf_sizes_partitions():
    conf = scale_conf(10 * 1024 * MB)  # 10 GiB
    assert conf["spark.sql.shuffle.partitions"] == "40"
    assert conf["spark.sql.files.maxPartitionBytes"] == str(256 * MB)
    big = scale_conf(100 * 1024 * 1024 * MB)  # 100 TiB
    assert big["spark.sql.shuffle.partitions"] == "409600"
    assert scale_conf(1)["spark.sql.shuffle.partitions"] == "1"


def test_shared_dir_is_the_session_checkpoint_dir(spark):
    folder = shared_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == folder  # stable


def test_materialize_round_trip(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    out = materialize(df, "test", partition_by=["k"])
    assert out.count() == 100
    assert sorted(r.k for r in out.select("k").distinct().collect()) == list(range(7))
    assert shared_dir(spark).split(":")[-1] in out.inputFiles()[0]
