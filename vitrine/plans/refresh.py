"""Refreshing the silver table from a new snapshot, partition by partition.

Every stored row carries a digest of its columns. A snapshot is compared with the table on (partition, digest) alone; only
partitions whose rows differ are written again, the files of the others stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, wide_rows
from ..sources.catalog import write_catalog

DIGEST = "row_digest"
PARTITION = "release_year"


@dataclass
class Refresh:
    """What a refresh did: values of the partition column, and rows on either side that the other lacks."""

    written: list
    dropped: list
    rows_added: int
    rows_removed: int


def row_digest(df: DataFrame) -> Column:
    """128-bit digest of a row: its columns in the order of their names, NULL told apart from empty text."""
    columns = sorted(c for c in df.columns if c != DIGEST)
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}))


def with_digest(df: DataFrame) -> DataFrame:
    return df.withColumn(DIGEST, row_digest(df))


def changed_partitions(stored: DataFrame, snapshot: DataFrame, partition: str = PARTITION) -> DataFrame:
    """``partition, n_added, n_removed, n_left``: the partitions whose rows are not the same multiset on both sides, with the
    snapshot's rows in them. A row that changes, and one whose partition changes, is removed on one side and
    added on the other; repeated rows count as often as they come. NULL is a partition like any other.

    One aggregate on (partition, digest): 16 bytes a row are shuffled, whatever the width of the table.
    """
    sides = stored.select(partition, DIGEST, F.lit(-1).alias("__r_n")).unionByName(
        snapshot.select(partition, DIGEST, F.lit(1).alias("__r_n"))
    )
    rows = sides.groupBy(partition, DIGEST).agg(
        F.sum("__r_n").alias("__r_d"), F.count_if(F.col("__r_n") > 0).alias("__r_new")
    )
    return (
        rows.groupBy(partition)
        .agg(
            F.sum(F.greatest("__r_d", F.lit(0))).alias("n_added"),
            F.sum(F.greatest(-F.col("__r_d"), F.lit(0))).alias("n_removed"),
            F.sum("__r_new").alias("n_left"),
        )
        .filter((F.col("n_added") > 0) | (F.col("n_removed") > 0))
    )


def refresh_silver(snapshot: DataFrame, path: str, partition: str = PARTITION) -> Refresh:
    """Brings the table at ``path`` to the state of ``snapshot`` (the whole new product table).

    Without a table the snapshot is written. Else the partitions that differ are overwritten, all of a
    partition at once, and those that the snapshot no longer has are removed. The driver sees one row per changed
    partition. The comparison is with what is stored, so a refresh that was interrupted is mended by the next one, and a
    repeated one writes nothing. The snapshot must not read from ``path``, and has the table's columns. Beside a table it is computed
    once, into the shared folder; the comparison reads two of its columns, the write those partitions that differ.
    """
    with wide_rows(snapshot.sparkSession):
        return _refresh(snapshot.sparkSession, with_digest(snapshot), path, partition)


def _refresh(spark: SparkSession, new: DataFrame, path: str, partition: str) -> Refresh:
    stored = _stored(spark, path)
    if stored is None:
        write_catalog(new, path, partition_by=[partition], mode="append")
        rows = _stored(spark, path).groupBy(partition).agg(F.count(F.lit(1)).alias("n")).collect()
        return Refresh(sorted((r[0] for r in rows), key=_nulls_first), [], sum(r["n"] for r in rows), 0)
    if set(stored.columns) != set(new.columns):
        raise ValueError(f"columns differ: {sorted(set(stored.columns) ^ set(new.columns))}; rebuild the table")
    new = materialize(new, "snapshot")
    rows = changed_partitions(stored, new, partition).collect()
    written = [r[partition] for r in rows if r["n_left"] > 0]
    dropped = [r[partition] for r in rows if r["n_left"] == 0]
    if written:
        wanted = F.col(partition).isin([w for w in written if w is not None])
        if None in written:
            wanted = F.coalesce(wanted, F.lit(False)) | F.col(partition).isNull()
        clustered = new.filter(wanted).hint("rebalance", partition)
        clustered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for value in dropped:
        _remove(spark, f"{path}/{partition}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")
    return Refresh(
        sorted(written, key=_nulls_first), sorted(dropped, key=_nulls_first),
        sum(r["n_added"] for r in rows), sum(r["n_removed"] for r in rows),
    )


def _nulls_first(value):
    return (value is not None, value)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    files, at = _file_system(spark, path)
    return spark.read.parquet(path) if files.exists(at) else None


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)
