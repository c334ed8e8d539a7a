"""Report invariants on the derived catalog (sf0.001)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vitrine.plans import charts, ext, genre, macro, platform, pricing
from vitrine.plans.pipeline import genres_of


@pytest.fixture(scope="module")
def genres(catalog):
    return genres_of(catalog)


def test_explode_count_matches_tokens(catalog, genres):
    tokens = catalog.select(
        F.size(F.filter("genre_array", lambda t: t.isNotNull() & (t != ""))).alias("n")
    ).filter(F.col("n") > 0)
    assert genres.count() == tokens.agg(F.sum("n")).first()[0]


def test_catalog_totals(catalog, genres):
    row = macro.catalog_totals(catalog).first()
    assert row.n_rows == catalog.count()
    assert row.n_ids == catalog.select("id").distinct().count()
    assert row.n_genres == genres.select("genre").distinct().count()
    assert row.n_genre_rows == genres.count()


def test_period_counts_sum_to_rows(catalog):
    total = macro.releases_per_period(catalog).agg(F.sum("count")).first()[0]
    assert total == catalog.count()
    labels = {r.covid_period for r in macro.releases_per_period(catalog).collect()}
    assert labels == {"unknown", "pre_covid", "covid", "post_covid"}


def test_profile_counts_plus_others_is_total(catalog):
    counts = platform.profile_counts(catalog).first()
    others = catalog.filter(F.col("platform_profile") == "Others").count()
    assert sum(counts) + others == catalog.count()
    quality = {r.platform_profile: r.nb_games for r in platform.profile_quality(catalog).collect()}
    assert quality["Windows only"] == counts.windows_only
    assert quality["Windows + macOS + Linux"] == counts.tri_platform


def test_platform_counts_two_ways(catalog):
    one_pass = platform.platform_counts(catalog).first()
    filtered = [catalog.filter(f"{c} = true").count() for c in ("platform_windows", "platform_mac", "platform_linux")]
    assert list(one_pass) == filtered
    share = {r.platform: r for r in platform.platform_share(catalog).collect()}
    assert share["Windows"].nb_games == one_pass.windows_count
    for r in share.values():
        assert 0 <= r.share_percent <= 100
        assert r.share_percent == pytest.approx(100 * r.nb_games / catalog.count())


def test_discount_share_two_ways(catalog):
    row = pricing.discount_share(catalog).first()
    assert row.n_discounted == catalog.filter("discount > 0").count()
    assert row.n_total == catalog.count()
    assert row.share_percent == pytest.approx(row.n_discounted / row.n_total * 100)


def test_discount_share_empty_is_null(catalog):
    row = pricing.discount_share(catalog.limit(0)).first()
    assert (row.n_discounted, row.n_total, row.share_percent) == (0, 0, None)


def test_top_k_is_prefix_of_full_sort(catalog):
    top = [tuple(r) for r in platform.top_windows_only(catalog, k=10).collect()]
    full = (
        catalog.filter("is_windows_only")
        .select("app_id", "name", "price", "total_reviews", "positive_ratio")
        .orderBy(F.col("total_reviews").desc_nulls_last(), F.col("app_id"))
        .collect()
    )
    assert top == [tuple(r) for r in full[:10]]
    pubs = macro.top_publishers(catalog, k=5).collect()
    counts = [r["count"] for r in pubs]
    assert counts == sorted(counts, reverse=True) and len(pubs) == 5


def test_high_potential_is_having_of_reviews(genres):
    hp = {r.genre for r in genre.high_potential_genres(genres, min_reviews=1000, min_rate=0.666).collect()}
    full = genre.genre_reviews(genres).collect()
    expect = {r.genre for r in full if r.sum_total_reviews >= 1000 and r.positive_rate >= 0.666}
    assert hp == expect and 0 < len(hp) < len(full)


def test_rows_vs_entities(genres):
    per_genre = {r.genre: r for r in genre.genre_platforms(genres).collect()}
    price_rows = {r.genre: r.nb_games for r in pricing.price_by_genre(genres).collect()}
    # a product listing a genre twice: rows >= distinct products
    assert all(price_rows[g] >= per_genre[g].nb_games for g in per_genre)
    assert any(price_rows[g] > per_genre[g].nb_games for g in per_genre)


def test_blockbusters(genres):
    ex = genre.blockbuster_examples(genres, min_reviews=150, min_ratio=0.9, min_price=0).collect()
    assert ex and all(r.total_reviews > 150 and r.positive_ratio > 0.9 and r.price > 0 for r in ex)
    per_genre = genre.blockbuster_genres(genres, min_reviews=150, min_ratio=0.9, min_price=0).collect()
    assert sum(r.nb_blockbusters for r in per_genre) >= len({r.name for r in ex})


def test_summary_exact_and_approx(catalog):
    exact = {r.statistic: r.value for r in pricing.price_summary_minor(catalog).collect()}
    approx = {r.statistic: r.value for r in pricing.price_summary_minor(catalog, approx=True).collect()}
    assert list(exact) == ["count", "mean", "stddev", "min", "25%", "50%", "75%", "max"]
    assert exact["min"] <= exact["25%"] <= exact["50%"] <= exact["75%"] <= exact["max"]
    for q in ("25%", "50%", "75%"):
        assert abs(exact[q] - approx[q]) <= 0.01 * (exact["max"] - exact["min"])


def test_median_approx_close(genres):
    exact = {r.genre: r.median_price_eur for r in pricing.price_by_genre(genres).collect()}
    approx = {r.genre: r.median_price_eur for r in pricing.price_by_genre(genres, approx=True).collect()}
    assert exact.keys() == approx.keys()
    for g in exact:
        assert abs(exact[g] - approx[g]) <= 0.05 * exact[g]


def test_samples_are_keyed(catalog):
    a = [tuple(r) for r in charts.promotion_sample(catalog).collect()]
    b = [tuple(r) for r in charts.promotion_sample(catalog).collect()]
    assert a == b and len(a) == 20 and all(r[4] > 0 for r in a)
    dates = charts.chart_dates(catalog, n=5).collect()
    assert [r.app_id for r in dates] == sorted(r.app_id for r in dates)


def test_histogram_total(catalog):
    hist = pricing.price_histogram(catalog, width=500).collect()
    paid = catalog.filter("price > 0").count()
    assert sum(r["count"] for r in hist) == paid
    assert all(r.bucket % 500 == 0 for r in hist)


def test_ext_reports(catalog, genres):
    corr = ext.ext_platform_corr(catalog).first()
    assert -1 <= corr.corr_platforms_ratio <= 1
    shares = ext.ext_genre_share(catalog).collect()
    n_products = catalog.select("app_id").distinct().count()
    assert all(r.n_products == n_products and 0 < r.share_percent <= 100 for r in shares)
    bands = ext.ext_price_bands(catalog).collect()
    assert sum(r.nb_games for r in bands) == charts.price_points(catalog).count()
    linux = ext.ext_linux_genres(genres).collect()
    assert linux and all(r.nb_games <= dict((g.genre, g.nb_games) for g in genre.genre_counts(genres).collect())[r.genre] for r in linux)


def test_small_helpers(catalog):
    from vitrine.operators import distinct_rows, preview, row_count

    assert row_count(catalog).first().n_rows == catalog.count()
    assert distinct_rows(catalog, ["publisher"]).first().n_distinct == catalog.select("publisher").distinct().count()
    rows = preview(catalog, ["app_id", "name"], 5).collect()
    assert [r.app_id for r in rows] == sorted(r.app_id for r in catalog.select("app_id").collect())[:5]
