"""Helpers shared by the operators: the shared folder, temporary tables,
column names that cannot clash, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space as the word contracts state it: [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"

# Spark deletes the shuffle files of a query when it ends, not when the driver's garbage collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Bytes of rows that go to a Python worker at once. Spark's own bounds are 10,000 rows and 64 MB: of whole texts the executor
# and the worker then hold several copies of tens of MB each, for every task that runs.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BATCH = 2 << 20

# The seed of the hashes that deal rows out to groups.
DEAL_SEED = 0x5EED


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where the session names none (local tests) a private folder is set for the
    life of the session; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="vitrine-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that
    later steps start from files that outlive any executor. The write's shuffle
    files go as soon as it is done."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("error").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def released(run: Callable, *forget: Callable) -> Callable:
    """``run`` for ``mapInArrow``; at a task's end ``forget`` is called and Arrow gives back what it keeps, since the worker process
    goes on to other steps beside an executor that grows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            pa.default_memory_pool().release_unused()

    return task


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of steps on whole texts to ``TEXT_BATCH`` bytes (one row more at most); a session's smaller bound stays.

    Spark reads the setting when a step runs, which for a returned DataFrame is after its operator, so it is not put back. Results do
    not depend on it.
    """
    runtime = spark._jsparkSession.sessionState().conf()
    if not 0 < runtime.arrowMaxBytesPerBatch() <= TEXT_BATCH:
        spark.conf.set(BATCH_BYTES, str(TEXT_BATCH))


def parts_for(n: int, target: int) -> int:
    return max(1, -(-n // target))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names`` for columns of one's own beside ``columns``: with as many ``_`` before them as it takes to be new."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name)
    return out


def null_safe(left: str, right: str, *columns: str) -> Column:
    """Equality of ``columns`` between the two aliases, nulls equal."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (``a``, ``b``: long):
    ``root`` is the smallest node reachable.

    Alternates the large-star and small-star steps, each a pair of shuffles, until
    the edges are stars; a round's edges are written to the shared folder, so
    the lineage stays one round deep. The rounds grow with the logarithm of the
    longest path; only a count and a checksum reach the driver. Hub nodes cost
    nothing extra: a step needs a node's minimum only (a partial aggregate) and
    a join that Spark may split.

    Edges from a node to itself are dropped; an empty table gives no rows.
    """
    pairs = (
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        .where("lo < hi")
        .distinct()
    )
    pairs = materialize(pairs, "edges")
    state = _checksum(pairs)
    if state[0] == 0:
        return pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    for _ in range(max_rounds):
        # Large star: every neighbour above a node moves to its smallest neighbour.
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(
            pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi")
        )
        large = large.distinct()
        # Small star: everything below a node, and the node, moves to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi"))
            .where("lo < hi")
            .distinct()
        )
        pairs = materialize(small, "edges")
        after = _checksum(pairs)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    return stars.unionAll(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _checksum(pairs: DataFrame) -> tuple:
    row = pairs.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]
