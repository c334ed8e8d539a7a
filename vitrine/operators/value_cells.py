"""Exact quantiles, means and extremes from a stored table of value cells.

A load of values is stored once, as counts per (group, value), sorted by value cell: a fixed grid of 16 cells per doubling, so cells of all
loads agree and their exact totals add up. A report reads the totals, which say in which cell a quantile lies and
at which rank, and then the counts of those cells alone. Loads are appended; what is stored is not read to add to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quantiles import _between, _null_safe_join, _ranks

# Cells per doubling; cell 0 holds zero, and these numbers lie beyond those of finite values (|16 log2 x| <= 17,184).
PER_DOUBLING, ZERO_AT, INFINITE, NOT_A_NUMBER = 16, 20_000, 40_000, 40_001
VALUE, CELL, N = "value", "cell", "n"


def value_cell(x: Column) -> Column:
    """The cell of a double: never falls as the value grows; infinity and NaN (the largest value) have their own."""
    size = F.abs(x)
    finite = (F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size)) * PER_DOUBLING) + ZERO_AT).cast("int")
    found = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(INFINITE)).otherwise(finite)
    return F.when(x.isNull(), None).when(F.isnan(x), F.lit(NOT_A_NUMBER)).when(x < 0, -found).otherwise(found)


def _corner(cell: Column) -> Column:
    """A cell's end nearer to zero; squares are summed about it, as they are small there beside the values'."""
    size = F.pow(F.lit(2.0), (F.abs(cell) - ZERO_AT) / float(PER_DOUBLING))
    return F.when((cell == 0) | (F.abs(cell) >= INFINITE), 0.0).when(cell < 0, -size).otherwise(size)


def store_values(df: DataFrame, groups: list[str], value: str, path: str) -> None:
    """Appends the rows of ``df`` to the table at ``path``: ``values`` (groups, cell, value, n), sorted by cell, and ``totals`` (groups,
    cell, n, sums), one row per group and cell. Rows without a value are counted under the cell NULL.

    One aggregate with partial counts, so a group or value that most rows have is one row a task; the totals are made
    from what was written.
    """
    # 0.0 added: minus zero is zero
    x = F.col(value).cast("double") + F.lit(0.0)
    counts = df.select(*groups, x.alias(VALUE)).groupBy(*groups, VALUE).agg(F.count(F.lit(1)).alias(N))
    load = f"{path}/load={_next_load(df.sparkSession, path)}"
    sorted_counts = counts.withColumn(CELL, value_cell(F.col(VALUE))).repartitionByRange(CELL, *groups)
    sorted_counts.sortWithinPartitions(CELL, *groups, VALUE).write.mode("error").parquet(f"{load}/values")
    written = df.sparkSession.read.parquet(f"{load}/values")
    weighted, apart = F.col(N) * F.col(VALUE), F.col(VALUE) - _corner(F.col(CELL))
    totals = written.groupBy(*groups, CELL).agg(
        F.sum(N).alias(N), F.sum(weighted).alias("total"), F.sum(F.col(N) * apart).alias("apart"),
        F.sum(F.col(N) * apart * apart).alias("squares"), F.min(VALUE).alias("least"), F.max(VALUE).alias("most"),
    )
    totals.write.mode("error").parquet(f"{load}/totals")


def _next_load(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(files.listStatus(at)) if files.exists(at) else 0


def stored_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/load=*/totals")


def stored_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/load=*/values")


def stored_quantiles(
    spark: SparkSession, path: str, probs: list[float], names: list[str], groups: list[str] | None = None, discrete: bool = False,
    keep: Column | None = None,
) -> DataFrame:
    """``groups`` + a double column per name: the quantiles ``probs`` of the stored values, exact, with the definitions of
    :func:`~vitrine.operators.quantiles.exact_quantiles`. ``groups`` may be some of the stored ones. ``keep`` is a condition on the cell
    (on the value it stands for, where the two agree).

    The driver sees the numbers of the cells that are wanted (at most as many as the grid has), which the scan of the values
    gets as a pushed filter: row groups of other cells are not read.
    """
    groups = list(groups or [])
    there = F.col(CELL).isNotNull() if keep is None else F.col(CELL).isNotNull() & keep
    cells = stored_totals(spark, path).filter(there).groupBy(*groups, CELL).agg(F.sum(N).alias("c"))
    in_group = Window.partitionBy(*groups)
    before = in_group.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    counts = cells.select(
        *groups, CELL, "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("b"), F.sum("c").over(in_group).alias("all")
    )
    targets = []
    for i, p in enumerate(probs):
        r1, r2, pos = _ranks(p, F.col("all"), discrete)
        targets += [
            F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (r - F.col("b")).alias("r"), pos.alias("pos"))
            for side, r in ((1, r1), (2, r2))
        ]
    wanted = counts.select(
        *groups, CELL, F.filter(F.array(*targets), lambda t: (t["r"] > 0) & (t["r"] <= F.col("c"))).alias("t")
    ).filter(F.size("t") > 0)
    numbers = sorted(r[CELL] for r in wanted.select(CELL).distinct().collect())
    values = stored_values(spark, path).filter(F.col(CELL).isin(numbers)).groupBy(*groups, CELL, VALUE).agg(F.sum(N).alias("c"))
    running = Window.partitionBy(*groups, CELL).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        _null_safe_join(values, wanted, [*groups, CELL], not_null=(CELL,))
        .withColumn("upto", F.sum("c").over(running))
        .select(*groups, VALUE, "c", "upto", F.explode("t").alias("t"))
        .filter((F.col("t.r") <= F.col("upto")) & (F.col("t.r") > F.col("upto") - F.col("c")))
    )
    at = lambda i, side, c: F.max(F.when((F.col("t.i") == i) & (F.col("t.side") == side), F.col(c)))
    ends = found.groupBy(*groups).agg(
        *[
            F.struct(at(i, 1, VALUE).alias("v1"), at(i, 2, VALUE).alias("v2"), at(i, 1, "t.pos").alias("pos")).alias(f"__q_{i}")
            for i in range(len(probs))
        ]
    )
    return ends.select(*groups, *[_between(F.col(f"__q_{i}")).alias(name) for i, name in enumerate(names)])


def stored_moments(spark: SparkSession, path: str, groups: list[str] | None = None, keep: Column | None = None) -> DataFrame:
    """``groups, n_rows, n, mean, stddev, least, most`` from the totals alone; ``n_rows`` counts rows without a value too
    (those that ``keep``, a condition on the cell, leaves). Squares are summed about the cells' corners and then about
    the mean, so a small spread of large values keeps its digits."""
    groups = list(groups or [])
    totals = stored_totals(spark, path)
    totals = totals if keep is None else totals.filter(keep)
    has = F.col(CELL).isNotNull()
    parts = F.sum("total"), F.sum(F.when(has, F.col(N)))
    if groups:
        whole = Window.partitionBy(*groups)
        mean = parts[0].over(whole) / parts[1].over(whole)
    else:
        mean = totals.agg(parts[0] / parts[1]).scalar()
    within = F.greatest(F.col("squares") - F.col("apart") * F.col("apart") / F.col(N), F.lit(0.0))
    off = F.col("total") / F.col(N) - F.col("mean")
    sums = (
        totals.withColumn("mean", mean)
        .groupBy(*groups)
        .agg(
            F.sum(N).alias("n_rows"), F.coalesce(F.sum(F.when(has, F.col(N))), F.lit(0)).alias(N), F.any_value("mean").alias("mean"),
            F.sum(within + F.col(N) * off * off).alias("spread"), F.min("least").alias("least"), F.max("most").alias("most"),
        )
    )
    deviation = F.when(F.col(N) > 1, F.sqrt(F.col("spread") / (F.col(N) - 1)))
    return sums.select(*groups, "n_rows", N, "mean", deviation.alias("stddev"), "least", "most")
