"""Edge rows of every column function, with ANSI mode on and off."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from vitrine.functions import (
    clean_date_text,
    count_tokens,
    extract_int,
    label_period,
    parse_date_multi,
    safe_ratio,
    share_percent,
    split_tokens,
    try_number,
)
from vitrine.operators.explode import explode_tokens
from vitrine.operators.features import with_platform_flags, with_platform_profile, with_review_features

D = dt.date

DATE_CASES = [
    ("Oct 21, 2008", "Oct 21 2008", D(2008, 10, 21)),
    ("Oct 1, 2008", "Oct 1 2008", D(2008, 10, 1)),
    ("oct 3 2010", "oct 3 2010", D(2010, 10, 3)),
    ("21 Oct, 2008", "21 Oct 2008", D(2008, 10, 21)),
    ("1 Oct 2008", "1 Oct 2008", D(2008, 10, 1)),
    ("2000/11/1", "2000-11-01", D(2000, 11, 1)),
    ("2000-1-1", "2000-01-01", D(2000, 1, 1)),
    ("2010/1/12", "2010-01-12", D(2010, 1, 12)),
    ("October 5, 2010", "October 5 2010", None),
    ("Oct 2008", "Oct 2008", None),
    ("2008", "2008", None),
    ("coming soon", "coming soon", None),
    ("", "", None),
    ("2008-13-01", "2008-13-01", None),
    ("Feb 30, 2011", "Feb 30 2011", None),
    ("2011-2-30", "2011-02-30", None),
    (None, None, None),
]


def test_dates(spark, ansi):
    df = spark.createDataFrame([(r,) for r, _, _ in DATE_CASES], "raw string")
    out = df.select("raw", clean_date_text("raw").alias("clean")).select(
        "raw", "clean", parse_date_multi("clean").alias("parsed")
    )
    got = {(r.raw, r.clean, r.parsed) for r in out.collect()}
    assert got == set(DATE_CASES)


def test_numbers(spark, ansi):
    df = spark.createDataFrame(
        [("abc",), ("n/a",), ("",), ("1e3",), (" 12 ",), ("12.7",), (None,)], "s string"
    )
    rows = df.select("s", try_number("s", "double").alias("d"), try_number("s", "bigint").alias("l")).collect()
    got = {r.s: (r.d, r.l) for r in rows}
    assert got["abc"] == (None, None)
    assert got["n/a"] == (None, None)
    assert got[""] == (None, None)
    assert got["1e3"][0] == 1000.0
    assert got[" 12 "][1] == 12
    assert got["12.7"] == (12.7, None)
    assert got[None] == (None, None)


def test_extract_int(spark, ansi):
    df = spark.createDataFrame([("17+",), ("MA 18",), ("PEGI",), (None,), ("0",)], "s string")
    got = {r.s: r.n for r in df.select("s", extract_int("s").alias("n")).collect()}
    assert got == {"17+": 17, "MA 18": 18, "PEGI": None, None: None, "0": 0}


def test_tokens(spark, ansi):
    df = spark.createDataFrame(
        [(1, "Action,  Indie,,RPG,"), (2, "Action,Indie, Action"), (3, None), (4, "")], "id int, g string"
    )
    arr = df.select("id", split_tokens("g").alias("a"))
    arrays = {r.id: r.a for r in arr.collect()}
    assert arrays[1] == ["Action", "Indie", "", "RPG", ""]
    exploded = explode_tokens(arr, "a", "genre").collect()
    by_id = {}
    for r in exploded:
        by_id.setdefault(r.id, []).append(r.genre)
    assert sorted(by_id[1]) == ["Action", "Indie", "RPG"]
    assert sorted(by_id[2]) == ["Action", "Action", "Indie"]
    assert 3 not in by_id and 4 not in by_id


def test_language_count(spark, ansi):
    df = spark.createDataFrame([(None,), ("",), ("English, French",)], "s string")
    rows = df.select("s", count_tokens(split_tokens("s", ",")).alias("n")).collect()
    assert {r.s: r.n for r in rows} == {None: None, "": 1, "English, French": 2}


def test_reviews(spark, ansi):
    df = spark.createDataFrame([(9, 1), (0, 0), (None, 1)], "positive bigint, negative bigint")
    rows = with_review_features(df).collect()
    got = [(r.total_reviews, r.positive_ratio) for r in rows]
    assert got == [(10, 0.9), (0, None), (None, None)]


def test_ratio_and_share(spark, ansi):
    df = spark.createDataFrame([(1, 4), (1, 0), (None, 2), (3, None)], "a bigint, b bigint")
    rows = df.select(safe_ratio("a", "b").alias("r"), share_percent("a", "b").alias("p")).collect()
    assert [(r.r, r.p) for r in rows] == [(0.25, 25.0), (None, None), (None, None), (None, None)]


def test_period(spark, ansi):
    df = spark.createDataFrame([(None,), (2018,), (2019,), (2021,), (2022,)], "y int")
    rows = df.select("y", label_period("y").alias("p")).collect()
    assert {r.y: r.p for r in rows} == {
        None: "unknown", 2018: "pre_covid", 2019: "covid", 2021: "covid", 2022: "post_covid"
    }


def test_platform_profiles(spark, ansi):
    T, Fa, N = True, False, None
    cases = [
        ((T, Fa, Fa), "Windows only"),
        ((T, T, Fa), "Windows + macOS"),
        ((T, Fa, T), "Windows + Linux"),
        ((T, T, T), "Windows + macOS + Linux"),
        ((Fa, T, Fa), "Others"),
        ((Fa, Fa, T), "Others"),
        ((Fa, T, T), "Others"),
        ((Fa, Fa, Fa), "Others"),
        ((N, Fa, Fa), "Others"),
        ((T, N, Fa), "Others"),
    ]
    df = spark.createDataFrame(
        [(i, *p) for i, (p, _) in enumerate(cases)],
        "i int, platform_windows boolean, platform_mac boolean, platform_linux boolean",
    )
    out = with_platform_profile(with_platform_flags(df))
    rows = {r.i: r for r in out.collect()}
    for i, (_, label) in enumerate(cases):
        assert rows[i].platform_profile == label
    # NULL-dependent rows count 0 in every flag
    flags = ["is_windows_only", "is_tri_platform", "is_windows_mac", "is_windows_linux"]
    for i in (8, 9):
        assert all(rows[i][f] is not True for f in flags)
    counted = out.agg(*[F.count_if(F.col(f)).alias(f) for f in flags]).first()
    assert [counted[f] for f in flags] == [1, 1, 1, 1]


def test_date_guard_changes_nothing(spark, ansi):
    """The shape guard only skips parsers that cannot succeed."""
    from vitrine.functions.dates import format_shape

    extra = ["Oct  21 2008", " 2000-01-01", "2000-01-01 ", "+2000-01-01", "Sept 1 2010", "1 oct 2008", "21-Oct-2008"]
    df = spark.createDataFrame([(r,) for r, _, _ in DATE_CASES] + [(e,) for e in extra], "raw string")
    df = df.select(clean_date_text("raw").alias("clean"))
    both = df.select(
        parse_date_multi("clean", guard=True).alias("g"), parse_date_multi("clean", guard=False).alias("u")
    )
    assert both.filter(~F.col("g").eqNullSafe(F.col("u"))).count() == 0
    assert format_shape("QQQ yyyy") is None
    assert format_shape("yyyy-MM-dd'T'HH:mm") == r"^\s*[+-]?\d+\-\d+\-\d+T\d+:\d+\s*$"
