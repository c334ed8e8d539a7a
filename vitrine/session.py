"""Session helpers: building a session with scale-friendly defaults and
locating the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every vitrine job wants. AQE re-plans joins and aggregations at
# runtime (coalesces tiny shuffle partitions, splits skewed join partitions,
# turns a join into a broadcast only when the measured side is small).
# The product features are CPU-heavy string work (regex clean-up, date
# parsing), so a small shuffle is not coalesced below 64 KB per partition:
# it stays spread over the cores. Large shuffles are sized by the advisory
# partition size as usual.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


MB = 1024 * 1024


def scale_conf(input_bytes: int, partition_bytes: int = 256 * MB) -> dict[str, str]:
    """Partition sizing for a job reading about ``input_bytes``.

    Scan splits and post-shuffle partitions target ``partition_bytes``
    (256 MB: comfortably inside a few-GB executor heap, large enough to keep
    task overhead low). ``spark.sql.shuffle.partitions`` is the *initial*
    count, sized so the largest shuffle (the full-width one) gets partitions
    of that size; AQE coalesces smaller shuffles down to the advisory size and
    splits skewed ones. E.g. 100 TiB → 409,600.
    """
    partitions = max(1, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
    }


def get_session(
    app_name: str = "vitrine",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
    input_bytes: int | None = None,
) -> SparkSession:
    """Return a session with :data:`DEFAULT_CONF` applied.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster
    leave them unset so the submit-time configuration wins, or pass
    ``input_bytes`` to size partitions with :func:`scale_conf`.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if input_bytes:
        conf.update(scale_conf(input_bytes))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for written intermediate tables: the
    one that ``spark.checkpoint.dir`` names. A cluster session without it is
    an error; a local session (tests) gets a private folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="vitrine-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def wide_rows(spark: SparkSession) -> Iterator[None]:
    """For jobs that write rows of many columns: whole-stage code for them is one method larger than HotSpot compiles, which then
    runs interpreted. Without it an operator's columns are split over small methods. The setting is put back at the end."""
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", before)


def write_shared(df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as Parquet to a new sub-folder of the shared folder and
    return its path (never reused, so concurrent runs cannot collide)."""
    path = os.path.join(shared_dir(df.sparkSession), "vitrine", f"{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts the lineage (a lost executor costs a re-read, not a recompute
    from the raw source) and gives the readers column pruning and predicate
    pushdown.
    """
    return df.sparkSession.read.parquet(write_shared(df, name, partition_by))
