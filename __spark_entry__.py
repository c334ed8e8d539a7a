"""

``entry(spark)`` runs the flagship report on sf0.001; ``queries()`` maps each
report / operator name to a callable ``(spark, sf_dir) -> DataFrame``;
``oracle_sql()`` gives the same result as DuckDB SQL over the raw tables.

Every query reads the driver tables in its own plan: the product catalog is
derived lazily from orders, customer and lineitem, so Catalyst prunes what a
report does not use, and rows added to the tables show up in the next call.
Queries of the ``llm`` subpackage and the corpus pipeline are added where
they can be imported.
Floating-point outputs are rounded to 6 places on both sides so that
summation order cannot change the comparison.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.features import prepare_catalog
from vitrine.operators.flatten import flatten_catalog
from vitrine.plans import cells, charts, ext, genre, macro, platform, pricing
from vitrine.plans.pipeline import build_catalog, build_silver, catalog_for, genres_of
from vitrine.plans.refresh import refresh_silver
from vitrine.session import materialize, shared_dir, wide_rows
from vitrine.sources.catalog import catalog_from_tables, read_catalog, read_silver, silver_extremes
from vitrine.sources.variant import field_types, read_variant, variant_records

SF_SMOKE = "/root/testdata/sf0.001"
DIGITS = 6

# Test parameters (leave some rows in and some out at sf0.001-0.1).
PERIOD = {"period_start": 1997, "period_end": 1999}
HIGH_POTENTIAL = {"min_reviews": 10000, "min_rate": 0.666}
BLOCKBUSTER = {"min_reviews": 150, "min_ratio": 0.9, "min_price": 0}
HISTOGRAM_WIDTH = 500


def _round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = [
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_for(spark, sf_dir, **PERIOD)


def _genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genres_of(_catalog(spark, sf_dir))


def _on_catalog(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _round_doubles(fn(_catalog(spark, sf_dir)))


def _on_genres(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _round_doubles(fn(_genres(spark, sf_dir)))


def _columns(*cols: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*cols)


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_catalog(catalog_from_tables(spark, sf_dir))


SCANNED = (
    "app_id", "name", "publisher", "price", "positive", "negative", "ccu", "required_age", "total_reviews",
    "num_languages", "platform_profile", "release_year",
)


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vitrine/{name}-{uuid.uuid4().hex}"


def _json_scan(spark: SparkSession, sf_dir: str, infer: bool) -> DataFrame:
    """The nested catalog written as JSON and read back, with the explicit or an inferred schema."""
    path = _scratch(spark, "json")
    catalog_from_tables(spark, sf_dir).write.json(path)
    raw = read_catalog(spark, path, schema=None) if infer else read_catalog(spark, path)
    return _round_doubles(build_catalog(raw, **PERIOD).select(*SCANNED))


def _silver_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product table written by release year (a null year too) and read back."""
    path = _scratch(spark, "silver")
    build_silver(_catalog(spark, sf_dir).drop("languages_array", "genre_array"), path)
    return _round_doubles(read_silver(spark, path).select(*SCANNED))


def _variant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as JSON lines with mixed types (prices of even products are numbers), fields that the schema does not name, and
    for every 199th product one more line that is cut short; written as text and read as VARIANT."""
    path = _scratch(spark, "lines")
    k = F.col("data.appid")
    platforms = F.col("data.platforms").withField("console", F.when(k % 19 == 0, F.lit(True)))
    data = F.col("data").withField("platforms", platforms).withField("region", F.when(k % 17 == 0, F.concat(F.lit("r"), k % 3)))
    line = F.to_json(F.struct("id", data.alias("data")))
    line = F.when(k % 2 == 0, F.regexp_replace(line, r'"price":"(\d+)"', r'"price":$1')).otherwise(line)
    cut = F.when(k % 199 == 0, line.substr(F.lit(1), F.length(line) - 7))
    catalog_from_tables(spark, sf_dir).select(F.explode(F.array_compact(F.array(line, cut))).alias("value")).write.text(path)
    return read_variant(spark, path)


def _variant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = variant_records(_variant_lines(spark, sf_dir))
    flat = flatten_catalog(records, keep=["extras", "broken"])
    table = prepare_catalog(flat, PERIOD["period_start"], PERIOD["period_end"])
    broken_id = F.regexp_extract("broken", r'"id":"(\d+)"', 1).alias("broken_id")
    return _round_doubles(table.select(*SCANNED, "extras", broken_id))


def _silver_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A silver table of an earlier snapshot (products missing, prices and release dates different), refreshed from the
    present one, and read back. Both snapshots come from one catalog, computed once."""
    path = _scratch(spark, "refreshed")
    with wide_rows(spark):
        now = materialize(_catalog(spark, sf_dir).drop("languages_array", "genre_array"), "now")
    moved = F.when(F.col("app_id") % 29 == 0, F.col("release_year") + 1).otherwise(F.col("release_year"))
    lower = F.when(F.col("app_id") % 31 == 0, F.col("price") - 1).otherwise(F.col("price"))
    earlier = now.filter(F.col("app_id") % 37 != 0).withColumns({"release_year": moved, "price": lower})
    refresh_silver(earlier, path)
    refresh_silver(now, path)
    return _round_doubles(read_silver(spark, path).select(*SCANNED))


def _silver_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and extremes per release year, from the footers of a silver table."""
    path = _scratch(spark, "extremes")
    build_silver(_catalog(spark, sf_dir).select("app_id", "price", "total_reviews", "release_year"), path)
    return _round_doubles(silver_extremes(spark, path, ["price", "total_reviews"]))


def _price_by_genre_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices stored in two loads, and the report over both."""
    path, genres, first = _scratch(spark, "genre-prices"), _genres(spark, sf_dir), F.col("app_id") % 3 == 0
    for load in (first, ~first):
        pricing.store_genre_prices(genres.filter(load), path)
    return _round_doubles(pricing.price_by_genre_stored(spark, path))


def _price_summary_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, catalog, first = _scratch(spark, "prices"), _catalog(spark, sf_dir), F.col("app_id") % 3 == 0
    for load in (first, ~first):
        pricing.store_prices(catalog.filter(load), path)
    return _round_doubles(pricing.price_summary_stored(spark, path))


def _on_cells(fn: Callable[[cells.Cells], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _round_doubles(fn(cells.store_cells(_catalog(spark, sf_dir))))


def _cells_of_two_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one half of the products, merged with those of the other half as a later load."""
    catalog, first = _catalog(spark, sf_dir), F.col("app_id") % 2 == 0
    earlier = cells.store_cells(catalog.filter(first))
    return cells.genre_counts_by_year(cells.store_cells(catalog.filter(~first), earlier))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: high-potential genres (explode → group → HAVING → sort)."""
    return queries()["high_potential_genres"](spark, SF_SMOKE)


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    try:
        import corpus_pipeline
        from vitrine.llm import queries as llm
    except ImportError:  # the subpackage is optional
        return {}
    return {**llm.queries(), "pipeline": corpus_pipeline.run}


def _llm_oracle_sql() -> dict[str, str]:
    try:
        import corpus_pipeline
        from vitrine.llm import queries as llm
    except ImportError:
        return {}
    return {**llm.oracle_sql(), **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **_llm_queries(),
        # sources / projection
        "flatten_catalog": _flat,
        # scalar features
        "normalize_numeric": _on_catalog(
            _columns("app_id", "price", "initialprice", "discount", "positive", "negative", "ccu")
        ),
        "extract_age": _on_catalog(_columns("app_id", "required_age_str", "required_age")),
        "price_major_units": _on_catalog(_columns("app_id", "price_eur", "initialprice_eur")),
        "clean_dates": _on_catalog(_columns("app_id", "release_date_clean")),
        "parse_dates": _on_catalog(
            _columns("app_id", "release_date_parsed", "release_year", "release_month")
        ),
        "label_period": _on_catalog(_columns("app_id", "covid_period")),
        "review_features": _on_catalog(_columns("app_id", "total_reviews", "positive_ratio")),
        "language_count": _on_catalog(_columns("app_id", "num_languages")),
        "explode_genres": _on_genres(_columns("app_id", "genre")),
        "platform_flags": _on_catalog(
            _columns("app_id", "is_windows_only", "is_tri_platform", "is_windows_mac", "is_windows_linux")
        ),
        "platform_profile": _on_catalog(_columns("app_id", "platform_profile")),
        # catalog-level reports
        "catalog_totals": _on_catalog(macro.catalog_totals),
        "releases_per_year": _on_catalog(macro.releases_per_year),
        "releases_per_period": _on_catalog(macro.releases_per_period),
        "age_distribution": _on_catalog(macro.age_distribution),
        "language_distribution": _on_catalog(macro.language_distribution),
        "top_publishers": _on_catalog(macro.top_publishers),
        "top_publishers_heavy": _on_catalog(macro.top_publishers_heavy),
        "top_names_heavy": _on_catalog(lambda c: macro.top_publishers_heavy(c, key="name")),
        # pricing
        "price_summary_minor": _on_catalog(pricing.price_summary_minor),
        "price_summary_major": _on_catalog(pricing.price_summary_major),
        "price_histogram": _on_catalog(lambda c: pricing.price_histogram(c, HISTOGRAM_WIDTH)),
        "discount_share": _on_catalog(pricing.discount_share),
        "price_by_genre": _on_genres(pricing.price_by_genre),
        "price_by_period": _on_catalog(pricing.price_by_period),
        "price_by_genre_stored": _price_by_genre_stored,
        "price_summary_stored": _price_summary_stored,
        # chart feeds
        "chart_platforms": _on_catalog(charts.chart_platforms),
        "chart_prices": _on_catalog(charts.chart_prices),
        "chart_ages": _on_catalog(charts.chart_ages),
        "chart_languages": _on_catalog(charts.chart_languages),
        "price_points": _on_catalog(charts.price_points),
        "promotion_sample": _on_catalog(charts.promotion_sample),
        "chart_dates": _on_catalog(charts.chart_dates),
        "price_density": _on_catalog(lambda c: charts.price_density(c).cells),
        "price_density_sample": _on_catalog(lambda c: charts.price_density(c).sample),
        "promotion_sample_by_profile": _on_catalog(charts.promotion_sample_by_profile),
        # genres
        "genre_counts": _on_genres(genre.genre_counts),
        "genre_reviews": _on_genres(genre.genre_reviews),
        "high_potential_genres": _on_genres(lambda g: genre.high_potential_genres(g, **HIGH_POTENTIAL)),
        "blockbuster_examples": _on_genres(lambda g: genre.blockbuster_examples(g, **BLOCKBUSTER)),
        "blockbuster_genres": _on_genres(lambda g: genre.blockbuster_genres(g, **BLOCKBUSTER)),
        "genre_platforms": _on_genres(genre.genre_platforms),
        # the same from stored cells
        "genre_counts_cells": _on_cells(cells.genre_counts),
        "genre_reviews_cells": _on_cells(cells.genre_reviews),
        "genre_platforms_cells": _on_cells(cells.genre_platforms),
        "profile_quality_cells": _on_cells(cells.profile_quality),
        "blockbuster_genres_cells": _on_catalog(lambda c: cells.blockbuster_genres(c, **BLOCKBUSTER)),
        "genre_years_two_loads": _cells_of_two_loads,
        # platforms
        "platform_counts": _on_catalog(platform.platform_counts),
        "platform_share": _on_catalog(platform.platform_share),
        "profile_counts": _on_catalog(platform.profile_counts),
        "profile_quality": _on_catalog(platform.profile_quality),
        "top_windows_only": _on_catalog(platform.top_windows_only),
        "top_tri_platform": _on_catalog(platform.top_tri_platform),
        # described-only analyses
        "ext_platform_corr": _on_catalog(ext.ext_platform_corr),
        "ext_platform_rank_corr": _on_catalog(ext.ext_platform_rank_corr),
        "ext_linux_genres": _on_genres(ext.ext_linux_genres),
        "ext_price_bands": _on_catalog(ext.ext_price_bands),
        "ext_genre_share": _on_catalog(ext.ext_genre_share),
        "ext_top_languages": _on_catalog(ext.ext_top_languages),
        # sources and sinks, by way of the shared folder
        "json_scan": lambda spark, sf_dir: _json_scan(spark, sf_dir, infer=False),
        "json_scan_inferred": lambda spark, sf_dir: _json_scan(spark, sf_dir, infer=True),
        "silver_scan": _silver_scan,
        "variant_scan": _variant_scan,
        "variant_field_types": lambda spark, sf_dir: field_types(_variant_lines(spark, sf_dir)),
        "silver_refresh": _silver_refresh,
        "silver_extremes": _silver_extremes,
    }


# --------------------------------------------------------------------------
# DuckDB oracle
# --------------------------------------------------------------------------

_FLAT_SQL = r"""
rv AS (
  SELECT l_orderkey,
         CAST(SUM(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS pos,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS neg
  FROM lineitem GROUP BY l_orderkey
),
flat AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
         o_orderkey AS app_id,
         concat('item ', CAST(o_orderkey AS VARCHAR)) AS name,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL
              WHEN o_orderkey % 89 = 0 THEN ''
              WHEN o_orderkey % 7 = 0 THEN concat(c_mktsegment, ',', o_orderpriority, ', ', c_mktsegment, ',')
              ELSE concat(c_mktsegment, ', ', o_orderpriority) END AS genre_raw,
         CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE c_name END AS publisher,
         c_name AS developer,
         CASE WHEN o_orderkey % 10 = 0 THEN 'dlc' ELSE 'item' END AS type,
         CASE WHEN o_orderkey % 101 = 0 THEN 'n/a' WHEN o_orderkey % 13 = 0 THEN '0'
              ELSE CAST(CAST(round(o_totalprice / 100) AS BIGINT) AS VARCHAR) END AS price_raw,
         CASE WHEN o_orderkey % 101 = 0 THEN 'n/a'
              ELSE CAST(CAST(round(o_totalprice / 90) AS BIGINT) AS VARCHAR) END AS initialprice_raw,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 9 * 10 AS VARCHAR) ELSE '0' END AS discount_raw,
         CASE o_orderkey % 11 WHEN 0 THEN '17+' WHEN 1 THEN 'MA 18' WHEN 2 THEN 'PEGI' WHEN 3 THEN NULL
              ELSE '0' END AS required_age_raw,
         pos AS positive_raw,
         neg AS negative_raw,
         CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN ''
              WHEN o_orderkey % 4 = 0 THEN 'English, French, German'
              WHEN o_orderkey % 2 = 0 THEN 'English, French' ELSE 'English' END AS languages_raw,
         CASE WHEN o_orderkey % 5 = 0 THEN '20,000 .. 50,000' ELSE '0 .. 20,000' END AS owners_raw,
         o_orderkey % 1000 AS ccu,
         o_orderkey % 5 = 0 AS platform_linux,
         o_orderkey % 4 = 0 AS platform_mac,
         CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE o_orderkey % 50 <> 0 END AS platform_windows,
         CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%b %-d, %Y')
              WHEN 1 THEN strftime(o_orderdate, '%-d %b, %Y')
              WHEN 2 THEN strftime(o_orderdate, '%Y/%-m/%-d')
              WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN 4 THEN 'coming soon' ELSE '' END AS release_date_raw
  FROM orders JOIN customer ON c_custkey = o_custkey
  LEFT JOIN rv ON l_orderkey = o_orderkey
)"""

_CATALOG_SQL = r""",
typed AS (
  SELECT *,
         TRY_CAST(price_raw AS DOUBLE) AS price,
         TRY_CAST(initialprice_raw AS DOUBLE) AS initialprice,
         TRY_CAST(discount_raw AS DOUBLE) AS discount,
         positive_raw AS positive,
         negative_raw AS negative,
         required_age_raw AS required_age_str,
         TRY_CAST(regexp_extract(required_age_raw, '(\d+)', 1) AS INTEGER) AS required_age,
         TRY_CAST(price_raw AS DOUBLE) / 100 AS price_eur,
         TRY_CAST(initialprice_raw AS DOUBLE) / 100 AS initialprice_eur,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(release_date_raw, ',', '', 'g'),
             '/', '-', 'g'), '-(\d)(\D|$)', '-0\1\2', 'g'), '-(\d)(\D|$)', '-0\1\2', 'g') AS release_date_clean
  FROM flat
),
dated AS (
  SELECT *,
         CAST(coalesce(try_strptime(release_date_clean, '%b %d %Y'),
                       try_strptime(release_date_clean, '%Y-%m-%d'),
                       try_strptime(release_date_clean, '%d %b %Y')) AS DATE) AS release_date_parsed
  FROM typed
),
feat AS (
  SELECT *,
         CAST(year(release_date_parsed) AS INTEGER) AS release_year,
         CAST(month(release_date_parsed) AS INTEGER) AS release_month,
         positive + negative AS total_reviews,
         CASE WHEN languages_raw IS NULL THEN NULL
              ELSE CAST(len(string_split(languages_raw, ',')) AS INTEGER) END AS num_languages,
         string_split_regex(genre_raw, ',\s*') AS genre_array,
         (platform_windows = true AND platform_mac = false AND platform_linux = false) AS is_windows_only,
         (platform_windows = true AND platform_mac = true AND platform_linux = true) AS is_tri_platform,
         (platform_windows = true AND platform_mac = true AND platform_linux = false) AS is_windows_mac,
         (platform_windows = true AND platform_mac = false AND platform_linux = true) AS is_windows_linux
  FROM dated
),
cat AS (
  SELECT *,
         CASE WHEN release_year IS NULL THEN 'unknown'
              WHEN release_year < 1997 THEN 'pre_covid'
              WHEN release_year >= 1997 AND release_year <= 1999 THEN 'covid'
              ELSE 'post_covid' END AS covid_period,
         CASE WHEN total_reviews > 0 THEN CAST(positive AS DOUBLE) / total_reviews END AS positive_ratio,
         CASE WHEN is_tri_platform THEN 'Windows + macOS + Linux'
              WHEN is_windows_mac THEN 'Windows + macOS'
              WHEN is_windows_linux THEN 'Windows + Linux'
              WHEN is_windows_only THEN 'Windows only'
              ELSE 'Others' END AS platform_profile
  FROM feat
),
genres AS (
  SELECT * FROM (SELECT *, unnest(genre_array) AS genre FROM cat)
  WHERE genre IS NOT NULL AND genre <> ''
)"""


def _with_catalog(body: str) -> str:
    return "WITH " + _FLAT_SQL + _CATALOG_SQL + "\n" + body


def _summary_sql(source: str, col: str) -> str:
    parts = [
        ("count", f"CAST(count({col}) AS DOUBLE)"),
        ("mean", f"avg({col})"),
        ("stddev", f"stddev_samp({col})"),
        ("min", f"CAST(min({col}) AS DOUBLE)"),
        ("25%", f"CAST(quantile_disc({col}, 0.25) AS DOUBLE)"),
        ("50%", f"CAST(quantile_disc({col}, 0.5) AS DOUBLE)"),
        ("75%", f"CAST(quantile_disc({col}, 0.75) AS DOUBLE)"),
        ("max", f"CAST(max({col}) AS DOUBLE)"),
    ]
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS statistic, round({expr}, 6) AS value FROM {source}" for name, expr in parts
    )


def _genre_reviews_sql(where: str = "") -> str:
    return f"""
SELECT genre, count(DISTINCT app_id) AS nb_games,
       CAST(sum(positive) AS BIGINT) AS sum_positive,
       CAST(sum(negative) AS BIGINT) AS sum_negative,
       CAST(sum(total_reviews) AS BIGINT) AS sum_total_reviews,
       round(CASE WHEN sum(total_reviews) > 0 THEN CAST(sum(positive) AS DOUBLE) / sum(total_reviews) END, 6)
         AS positive_rate
FROM genres {where} GROUP BY genre"""


def _top_by_reviews_sql(flag: str) -> str:
    return f"""
SELECT app_id, name, round(price, 6) AS price, total_reviews, round(positive_ratio, 6) AS positive_ratio
FROM cat WHERE {flag}
ORDER BY total_reviews DESC NULLS LAST, app_id ASC NULLS LAST LIMIT 10"""


_RANK_CORR_SQL = """
SELECT count(*) AS n_pairs, round(corr(rx, ry), 6) AS rank_correlation FROM (
  SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM (SELECT CAST(coalesce(platform_windows, false) AS INTEGER) + CAST(coalesce(platform_mac, false) AS INTEGER)
               + CAST(coalesce(platform_linux, false) AS INTEGER) AS x, positive_ratio AS y
        FROM cat WHERE positive_ratio IS NOT NULL))"""

_BOTTOM_K_SQL = """
SELECT platform_profile, app_id, name, round(price_eur, 6) AS price_eur, round(discount, 6) AS discount,
       round(coalesce(next, 1.0), 6) AS inclusion
FROM (SELECT *, row_number() OVER w AS place, max(luck) FILTER (WHERE k = 21) OVER (PARTITION BY platform_profile) AS next
      FROM (SELECT *, CAST(('0x' || substr(md5(CAST(app_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 AS luck,
                   row_number() OVER (PARTITION BY platform_profile ORDER BY substr(md5(CAST(app_id AS VARCHAR)), 1, 13), app_id) AS k
            FROM cat WHERE discount > 0)
      WINDOW w AS (PARTITION BY platform_profile ORDER BY k))
WHERE place <= 20"""


def _density_sql(body: str) -> str:
    """Quartered cells of the price and review logarithms: 8 levels, at most 400 cells."""
    levels = ",\n".join(
        f"l{d} AS (SELECT *, count(*) OVER (PARTITION BY gx >> {8 - d}, gy >> {8 - d}) AS c{d} FROM {f'l{d - 1}' if d else 'grid'})"
        for d in range(9)
    )
    depth = "CASE " + " ".join(f"WHEN c{d} <= most THEN {d}" for d in range(8)) + " ELSE 8 END"
    return f"""pts AS (
  SELECT app_id, round(log2(price_eur), 9) AS x, round(log2(total_reviews), 9) AS y FROM cat WHERE total_reviews > 0 AND price_eur > 0
),
b AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
             greatest(1, CAST(ceil(24 * count(*) / 399.0) AS BIGINT)) AS most FROM pts),
grid AS (SELECT pts.*, b.most, CAST(least(floor((x - x0) / (x1 - x0) * 256), 255) AS INTEGER) AS gx,
                CAST(least(floor((y - y0) / (y1 - y0) * 256), 255) AS INTEGER) AS gy FROM pts, b),
{levels},
deep AS (SELECT *, {depth} AS depth FROM l8),
leaf AS (SELECT *, gx >> (8 - depth) AS ix, gy >> (8 - depth) AS iy FROM deep)
{body}"""


_VARIANT_SCAN_SQL = """
SELECT app_id, name, publisher, round(price, 6) AS price, positive, negative, ccu, required_age, total_reviews, num_languages,
       platform_profile, release_year,
       CASE WHEN app_id % 17 = 0 AND app_id % 19 = 0
              THEN concat('{"data.region":"r', app_id % 3, '","data.platforms.console":true}')
            WHEN app_id % 17 = 0 THEN concat('{"data.region":"r', app_id % 3, '"}')
            WHEN app_id % 19 = 0 THEN '{"data.platforms.console":true}' END AS extras,
       NULL AS broken_id
FROM cat
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Others', NULL, NULL, CAST(app_id AS VARCHAR)
FROM cat WHERE app_id % 199 = 0"""


def _field_types_sql() -> str:
    number_price = "price_raw IS NOT NULL AND app_id % 2 = 0 AND regexp_full_match(price_raw, '[0-9]+')"
    fields = [("id", "STRING", "id"), ("data", "OBJECT", "id"), ("data.platforms", "OBJECT", "id")]
    fields += [(f"data.{f}", "STRING", c) for f, c in (
        ("name", "name"), ("genre", "genre_raw"), ("publisher", "publisher"), ("developer", "developer"), ("type", "type"),
        ("initialprice", "initialprice_raw"), ("discount", "discount_raw"), ("required_age", "required_age_raw"),
        ("languages", "languages_raw"), ("owners", "owners_raw"), ("release_date", "release_date_raw"))]
    fields += [(f"data.{f}", "BIGINT", c) for f, c in (
        ("appid", "app_id"), ("positive", "positive_raw"), ("negative", "negative_raw"), ("ccu", "ccu"))]
    rows = [(p, t, f"{c} IS NOT NULL") for p, t, c in fields]
    rows += [("data.price", "BIGINT", number_price), ("data.price", "STRING", f"price_raw IS NOT NULL AND NOT ({number_price})"),
             ("data.region", "STRING", "app_id % 17 = 0")]
    parts = [f"SELECT '{p}' AS path, '{t}' AS type, CAST(count_if({c}) AS BIGINT) AS n_records FROM flat" for p, t, c in rows]
    return "WITH " + _FLAT_SQL + "\nSELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE n_records > 0"


def oracle_sql() -> dict[str, str]:
    flat_cols = (
        "id, app_id, name, genre_raw, publisher, developer, type, price_raw, initialprice_raw, discount_raw, "
        "required_age_raw, positive_raw, negative_raw, languages_raw, owners_raw, ccu, platform_linux, "
        "platform_mac, platform_windows, release_date_raw"
    )
    hp, bb = HIGH_POTENTIAL, BLOCKBUSTER
    bb_where = (
        f"total_reviews > {bb['min_reviews']} AND positive_ratio > {bb['min_ratio']} AND price > {bb['min_price']}"
    )
    sql = {
        "flatten_catalog": "WITH " + _FLAT_SQL + f"\nSELECT {flat_cols} FROM flat",
        "normalize_numeric": "SELECT app_id, round(price, 6) AS price, round(initialprice, 6) AS initialprice, "
        "round(discount, 6) AS discount, positive, negative, ccu FROM cat",
        "extract_age": "SELECT app_id, required_age_str, required_age FROM cat",
        "price_major_units": "SELECT app_id, round(price_eur, 6) AS price_eur, "
        "round(initialprice_eur, 6) AS initialprice_eur FROM cat",
        "clean_dates": "SELECT app_id, release_date_clean FROM cat",
        "parse_dates": "SELECT app_id, release_date_parsed, release_year, release_month FROM cat",
        "label_period": "SELECT app_id, covid_period FROM cat",
        "review_features": "SELECT app_id, total_reviews, round(positive_ratio, 6) AS positive_ratio FROM cat",
        "language_count": "SELECT app_id, num_languages FROM cat",
        "explode_genres": "SELECT app_id, genre FROM genres",
        "platform_flags": "SELECT app_id, is_windows_only, is_tri_platform, is_windows_mac, is_windows_linux FROM cat",
        "platform_profile": "SELECT app_id, platform_profile FROM cat",
        "catalog_totals": "SELECT (SELECT count(*) FROM cat) AS n_rows, "
        "(SELECT count(*) FROM (SELECT DISTINCT id FROM cat)) AS n_ids, "
        "(SELECT count(DISTINCT genre) FROM genres) AS n_genres, (SELECT count(*) FROM genres) AS n_genre_rows",
        "releases_per_year": 'SELECT release_year, count(*) AS "count" FROM cat GROUP BY release_year',
        "releases_per_period": 'SELECT covid_period, count(*) AS "count" FROM cat GROUP BY covid_period',
        "age_distribution": 'SELECT required_age, count(*) AS "count" FROM cat GROUP BY required_age',
        "language_distribution": 'SELECT num_languages, count(*) AS "count" FROM cat GROUP BY num_languages',
        "top_publishers": 'SELECT publisher, count(*) AS "count" FROM cat GROUP BY publisher '
        'ORDER BY "count" DESC, publisher ASC NULLS LAST LIMIT 50',
        "price_summary_minor": "paid AS (SELECT price FROM cat WHERE price IS NOT NULL AND price > 0)\n"
        + _summary_sql("paid", "price"),
        "price_summary_major": _summary_sql("cat", "price_eur"),
        "price_histogram": f'SELECT CAST(floor(price / {HISTOGRAM_WIDTH}) * {HISTOGRAM_WIDTH} AS BIGINT) AS bucket, '
        'count(*) AS "count" FROM cat WHERE price IS NOT NULL AND price > 0 GROUP BY 1',
        "discount_share": "SELECT n_discounted, n_total, "
        "round(CASE WHEN n_total > 0 THEN CAST(n_discounted AS DOUBLE) / n_total END * 100, 6) AS share_percent "
        "FROM (SELECT CAST(count_if(discount > 0) AS BIGINT) AS n_discounted, count(*) AS n_total FROM cat)",
        "price_by_genre": "SELECT genre, count(*) AS nb_games, round(avg(price_eur), 6) AS avg_price_eur, "
        "round(quantile_cont(price_eur, 0.5), 6) AS median_price_eur FROM genres GROUP BY genre",
        "price_by_period": "SELECT covid_period, count(*) AS nb_games, round(avg(price_eur), 6) AS avg_price_eur, "
        "round(avg(discount), 6) AS avg_discount FROM cat GROUP BY covid_period",
        "chart_platforms": 'SELECT app_id, platform_windows AS "Windows", platform_mac AS "Mac", '
        'platform_linux AS "Linux" FROM cat',
        "chart_prices": "SELECT round(price, 6) AS price FROM cat WHERE price IS NOT NULL AND price > 0",
        "chart_ages": "SELECT required_age FROM cat",
        "chart_languages": "SELECT num_languages FROM cat",
        "price_points": "SELECT app_id, round(price_eur, 6) AS price_eur, total_reviews, "
        "round(positive_ratio, 6) AS positive_ratio FROM cat WHERE total_reviews > 0 AND price_eur > 0",
        "promotion_sample": "SELECT app_id, name, round(price_eur, 6) AS price_eur, "
        "round(initialprice_eur, 6) AS initialprice_eur, round(discount, 6) AS discount "
        "FROM cat WHERE discount > 0 ORDER BY app_id LIMIT 20",
        "chart_dates": "SELECT app_id, release_date_raw, release_date_clean, release_date_parsed "
        "FROM cat ORDER BY app_id LIMIT 20",
        "genre_counts": "SELECT genre, count(DISTINCT app_id) AS nb_games FROM genres GROUP BY genre",
        "genre_reviews": _genre_reviews_sql(),
        "high_potential_genres": "SELECT * FROM (" + _genre_reviews_sql() + ") r "
        f"WHERE sum_total_reviews >= {hp['min_reviews']} AND positive_rate >= {hp['min_rate']}",
        "blockbuster_examples": "SELECT DISTINCT name, genre, round(price, 6) AS price, total_reviews, "
        f"round(positive_ratio, 6) AS positive_ratio FROM genres WHERE {bb_where}",
        "blockbuster_genres": "SELECT genre, count(DISTINCT app_id) AS nb_blockbusters "
        f"FROM genres WHERE {bb_where} GROUP BY genre",
        "genre_platforms": "SELECT genre, count(DISTINCT app_id) AS nb_games, "
        "CAST(count_if(platform_windows) AS BIGINT) AS nb_windows, "
        "CAST(count_if(platform_mac) AS BIGINT) AS nb_mac, "
        "CAST(count_if(platform_linux) AS BIGINT) AS nb_linux FROM genres GROUP BY genre",
        "platform_counts": "SELECT CAST(count_if(platform_windows) AS BIGINT) AS windows_count, "
        "CAST(count_if(platform_mac) AS BIGINT) AS mac_count, "
        "CAST(count_if(platform_linux) AS BIGINT) AS linux_count FROM cat",
        "platform_share": "counts AS (SELECT count(*) AS n, CAST(count_if(platform_windows) AS BIGINT) AS w, "
        "CAST(count_if(platform_mac) AS BIGINT) AS m, CAST(count_if(platform_linux) AS BIGINT) AS l FROM cat)\n"
        "SELECT 'Windows' AS platform, w AS nb_games, round(CAST(w AS DOUBLE) / n * 100, 6) AS share_percent "
        "FROM counts UNION ALL "
        "SELECT 'macOS', m, round(CAST(m AS DOUBLE) / n * 100, 6) FROM counts UNION ALL "
        "SELECT 'Linux', l, round(CAST(l AS DOUBLE) / n * 100, 6) FROM counts",
        "profile_counts": "SELECT CAST(count_if(is_windows_only) AS BIGINT) AS windows_only, "
        "CAST(count_if(is_tri_platform) AS BIGINT) AS tri_platform, "
        "CAST(count_if(is_windows_mac) AS BIGINT) AS windows_mac, "
        "CAST(count_if(is_windows_linux) AS BIGINT) AS windows_linux FROM cat",
        "profile_quality": "SELECT platform_profile, count(DISTINCT app_id) AS nb_games, "
        "round(avg(positive_ratio), 6) AS avg_positive_ratio, round(avg(total_reviews), 6) AS avg_total_reviews, "
        "round(avg(price), 6) AS avg_price FROM cat GROUP BY platform_profile",
        "top_windows_only": _top_by_reviews_sql("is_windows_only"),
        "top_tri_platform": _top_by_reviews_sql("is_tri_platform"),
        "ext_platform_corr": "SELECT count(*) AS n_products, round(corr(n_platforms, positive_ratio), 6) "
        "AS corr_platforms_ratio FROM (SELECT CAST(coalesce(platform_windows, false) AS INTEGER) "
        "+ CAST(coalesce(platform_mac, false) AS INTEGER) + CAST(coalesce(platform_linux, false) AS INTEGER) "
        "AS n_platforms, positive_ratio FROM cat WHERE positive_ratio IS NOT NULL)",
        "ext_linux_genres": _genre_reviews_sql("WHERE platform_linux"),
        "ext_price_bands": "SELECT price_band, count(*) AS nb_games, CAST(sum(total_reviews) AS BIGINT) "
        "AS sum_total_reviews, round(avg(total_reviews), 6) AS avg_total_reviews, "
        "round(avg(positive_ratio), 6) AS avg_positive_ratio FROM (SELECT *, CASE WHEN price_eur < 5 THEN '0-5' "
        "WHEN price_eur < 20 THEN '5-20' WHEN price_eur < 40 THEN '20-40' ELSE '40+' END AS price_band "
        "FROM cat WHERE total_reviews > 0 AND price_eur > 0) GROUP BY price_band",
        "ext_genre_share": "SELECT genre, count(DISTINCT app_id) AS nb_games, "
        "(SELECT count(DISTINCT app_id) FROM cat) AS n_products, "
        "round(CAST(count(DISTINCT app_id) AS DOUBLE) / (SELECT count(DISTINCT app_id) FROM cat) * 100, 6) "
        "AS share_percent FROM genres GROUP BY genre",
    }
    scanned = "SELECT app_id, name, publisher, round(price, 6) AS price, positive, negative, ccu, required_age, " \
        "total_reviews, num_languages, platform_profile, release_year FROM cat"
    sql |= {name: scanned for name in ("json_scan", "json_scan_inferred", "silver_scan", "silver_refresh")}
    sql |= {f"{name}_cells": sql[name] for name in (
        "genre_counts", "genre_reviews", "genre_platforms", "profile_quality", "blockbuster_genres")}
    sql["genre_years_two_loads"] = (
        "SELECT genre, release_year, count(DISTINCT app_id) AS nb_games FROM genres GROUP BY genre, release_year"
    )
    sql["top_publishers_heavy"] = sql["top_publishers"]
    sql["top_names_heavy"] = sql["top_publishers"].replace("publisher", "name")
    sql["price_by_genre_stored"] = sql["price_by_genre"]
    sql["price_summary_stored"] = sql["price_summary_minor"]
    sql["silver_extremes"] = (
        "SELECT release_year, count(*) AS n_rows, count(price) AS n_price, round(min(price), 6) AS min_price, round(max(price), 6) AS max_price, "
        "count(total_reviews) AS n_total_reviews, min(total_reviews) AS min_total_reviews, max(total_reviews) AS max_total_reviews "
        "FROM cat GROUP BY release_year"
    )
    sql["promotion_sample_by_profile"] = _BOTTOM_K_SQL
    sql["price_density"] = _density_sql(
        "SELECT CAST(depth AS INTEGER) AS depth, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, "
        "round(x0 + (x1 - x0) * ix / pow(2.0, depth), 6) AS x_from, round(x0 + (x1 - x0) * (ix + 1) / pow(2.0, depth), 6) AS x_to, "
        "round(y0 + (y1 - y0) * iy / pow(2.0, depth), 6) AS y_from, round(y0 + (y1 - y0) * (iy + 1) / pow(2.0, depth), 6) AS y_to, "
        "count(*) AS n FROM leaf, b GROUP BY ALL"
    )
    sql["price_density_sample"] = _density_sql(
        "SELECT CAST(depth AS INTEGER) AS depth, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, "
        "min(struct_pack(luck := md5(CAST(app_id AS VARCHAR)), app_id := app_id)).app_id AS app_id, "
        "round(arg_min(x, md5(CAST(app_id AS VARCHAR))), 6) AS log_price, round(arg_min(y, md5(CAST(app_id AS VARCHAR))), 6) AS log_reviews, "
        "count(*) AS weight FROM leaf GROUP BY depth, ix, iy"
    )
    sql["ext_platform_rank_corr"] = _RANK_CORR_SQL
    sql["variant_scan"] = _VARIANT_SCAN_SQL
    sql["variant_field_types"] = _field_types_sql()
    sql["ext_top_languages"] = (
        "SELECT language, count(DISTINCT app_id) AS nb_games FROM (SELECT app_id, trim(unnest(string_split(languages_raw, ','))) "
        "AS language FROM cat) WHERE language <> '' GROUP BY language"
    )
    out = {}
    for name, body in sql.items():
        if body.startswith("WITH "):
            out[name] = body
        elif body.startswith(("paid AS", "counts AS", "pts AS")):
            out[name] = "WITH " + _FLAT_SQL + _CATALOG_SQL + ",\n" + body
        else:
            out[name] = _with_catalog(body)
    return {**out, **_llm_oracle_sql()}


if __name__ == "__main__":  # pragma: no cover - manual smoke run
    from vitrine.session import get_session

    session = get_session(master="local[*]", shuffle_partitions=8)
    entry(session).show(truncate=False)
    print(sorted(set(queries()) - set(oracle_sql())), os.getcwd())
