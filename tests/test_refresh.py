"""Incremental silver: the table of a full rebuild, and untouched files where nothing changed."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from vitrine import session
from vitrine.plans.refresh import DIGEST, refresh_silver

SCHEMA = "app_id long, name string, price double, tags array<string>, release_year int"
FIRST = [
    (1, "a", 1.0, ["x"], 2000), (2, "b", None, None, 2000), (3, "c", 3.0, [], 2001), (4, "d", 4.0, ["y"], None),
    (5, None, 5.0, ["x"], 2002), (6, "f", 6.0, ["x"], 2003), (6, "f", 6.0, ["x"], 2003),
]


def files(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet")
    }


def table(spark, path):
    return sorted(map(str, spark.read.parquet(path).drop(DIGEST).select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "silver")
    done = refresh_silver(frame(spark, FIRST), path)
    assert done.written == [None, 2000, 2001, 2002, 2003] and done.rows_added == len(FIRST)
    return path


def refresh(spark, path, rows):
    before = files(path)
    done = refresh_silver(frame(spark, rows), path)
    assert table(spark, path) == sorted(map(str, frame(spark, rows).collect()))
    kept = {f for f, t in files(path).items() if before.get(f) == t}
    touched = {os.path.basename(os.path.dirname(f)).split("=")[1] for f in set(before) - kept}
    return done, touched


def test_the_same_snapshot_writes_nothing(spark, stored):
    done, touched = refresh(spark, stored, list(reversed(FIRST)))
    assert done.written == [] and done.dropped == [] and touched == set()


def test_a_changed_value_touches_its_partition_alone(spark, stored):
    rows = [(1, "a", 1.5, ["x"], 2000), *FIRST[1:]]
    done, touched = refresh(spark, stored, rows)
    assert done.written == [2000] and (done.rows_added, done.rows_removed) == (1, 1) and touched == {"2000"}


def test_null_is_not_empty(spark, stored):
    done, _ = refresh(spark, stored, [r if r[0] != 5 else (5, "", 5.0, ["x"], 2002) for r in FIRST])
    assert done.written == [2002]


def test_a_year_change_moves_a_product(spark, stored):
    done, touched = refresh(spark, stored, [r if r[0] != 2 else (*r[:4], 2001) for r in FIRST])
    assert done.written == [2000, 2001] and touched == {"2000", "2001"}


def test_emptied_new_and_null_partitions(spark, stored):
    rows = [r for r in FIRST if r[0] not in (3, 4)] + [(9, "new", 9.0, None, 2010)]
    done, touched = refresh(spark, stored, rows)
    assert done.written == [2010] and done.dropped == [None, 2001] and touched == {"2001", "__HIVE_DEFAULT_PARTITION__"}
    done, _ = refresh(spark, stored, [*rows, (10, "n", None, None, None)])
    assert done.written == [None]


def test_repeated_rows_count_as_often_as_they_come(spark, stored):
    done, touched = refresh(spark, stored, FIRST[:-1])
    assert done.written == [2003] and done.rows_removed == 1 and touched == {"2003"}


def test_an_interrupted_refresh_is_mended_by_the_next(spark, stored, monkeypatch):
    from vitrine.plans import refresh as module

    rows = [r for r in FIRST if r[0] != 3] + [(1, "more", 2.0, None, 2002)]

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(module, "_remove", fail)
        with pytest.raises(OSError):
            refresh_silver(frame(spark, rows), stored)
    done, _ = refresh(spark, stored, rows)
    assert done.written == [] and done.dropped == [2001]


def test_other_columns_are_refused(spark, stored):
    with pytest.raises(ValueError, match="extra"):
        refresh_silver(frame(spark, FIRST).withColumn("extra", F.lit(1)), stored)


def test_two_snapshots_of_the_catalog(spark, tmp_path, catalog):
    path = str(tmp_path / "catalog")
    now = catalog.drop("languages_array", "genre_array")
    refresh_silver(now.filter(F.col("app_id") % 5 != 0), path)
    refresh_silver(now, path)
    again = refresh_silver(now, path)
    assert again.written == [] and again.dropped == []
    assert spark.read.parquet(path).count() == now.count()
    assert spark.read.parquet(path).drop(DIGEST).select(*now.columns).exceptAll(now).count() == 0


def test_the_snapshot_is_computed_once(spark, stored):
    count = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (count.add(1), x)[1], "double").asNondeterministic()
    done = refresh_silver(frame(spark, [*FIRST, (7, "g", 7.0, ["x"], 2003)]).withColumn("price", seen("price")), stored)
    assert done.written == [2003] and count.value == len(FIRST) + 1


def test_wide_jobs_run_without_one_large_method(spark, stored):
    key = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(key)
    seen = []
    with pytest.raises(ZeroDivisionError), session.wide_rows(spark):
        seen.append(spark.conf.get(key))
        1 / 0
    assert seen == ["false"] and spark.conf.get(key) == before
    with pytest.raises(ValueError):
        refresh_silver(frame(spark, FIRST).drop("name"), stored)
    assert spark.conf.get(key) == before
