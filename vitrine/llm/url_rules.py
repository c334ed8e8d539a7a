"""URL filter by hashed expressions.

Every URL is expanded into (host suffix, path prefix) expressions; the
expressions meet the rules in an equi-join on the first hex digits of their SHA-256
digest; the whole digest then confirms the match, and rule precedence picks one
rule. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hex digits of a digest that the join compares; the rest is confirmed afterwards.
PREFIX_DIGITS = 8
# Up to so many rules the rule table (at most about 150 bytes a rule) is broadcast.
BROADCAST_RULES = 100_000
# Beyond that, each rule is copied to so many salts, so that one expression that
# a third of all URLs share is joined in so many tasks.
SALTS = 16

ALLOW, BLOCK = "allow", "block"


def url_host(url: Column) -> Column:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
    A-Z lower-cased; empty for a null URL or one without ``://``."""
    host = F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Array of ``host_suffix || path_prefix`` for every suffix of at most ``labels`` labels (those of the longest rule) and
    every prefix length that some rule has, so the rules bound a row's expressions, however long its URL."""
    end = F.split(F.substring_index(host, ".", -labels), r"\.")
    count = F.size(end)
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(end, i, count), "."))
    suffixes = F.when(host == "", F.array().cast("array<string>")).otherwise(suffixes)
    kept = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(kept, lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(
        F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    )


def match_url_rules(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = ALLOW,
) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``host``, ``path`` (starting with ``/``) and ``verdict``. A rule fits its
    host and all subdomains where the URL's path starts with the rule's path;
    the longest ``host || path`` wins. Of rules with the same text, block wins.
    Of fitting rules with equal length (``org/ab`` and ``x.org/``), the longer host wins. Without
    a fitting rule ``rule`` is null and the verdict is ``default``.

    Null URLs and URLs without ``://`` have empty host and path and get the default.
    Repeated rows are returned as often as they came; other
    columns are ignored; empty tables give no rows; an empty rule
    table gives the default everywhere. Rules with a null field are ignored.

    Scale: rows are numbered where they are read; expressions, digests and, while the rules fit a broadcast (checked
    count), the join run in the scan's tasks, and each row leaves them as one partial aggregate. The only shuffle is by
    row number, so no URL is too frequent.
    """
    rule = (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(
            F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"),
            F.length("path").alias("path_len"), F.size(F.split("host", r"\.")).alias("labels"), "verdict",
        )
        .groupBy("rule", "host_len", "path_len", "labels")
        .agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
    )
    # One row: the distinct path lengths, at most as many as the longest path has characters.
    stats = rule.agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("path_len")).alias("lens"), F.max("labels").alias("labels")
    ).first()
    hashed = rule.withColumn("digest", F.sha2("rule", 256)).withColumn(
        "short", F.substring("digest", 1, PREFIX_DIGITS)
    )
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"),
        url_host(F.col(url_col)).alias("_host"), url_path(F.col(url_col)).alias("_path"),
    )
    expr = _expressions(F.col("_host"), F.col("_path"), stats["labels"] or 1, list(stats["lens"]) or [0])
    asked = rows.select(
        "_row", "_id", "_host", "_path", F.explode_outer(F.transform(expr, lambda e: F.sha2(e, 256))).alias("_digest")
    ).withColumn("_short", F.substring("_digest", 1, PREFIX_DIGITS))
    if stats["n"] <= BROADCAST_RULES:
        joined = asked.join(F.broadcast(hashed), F.col("_short") == F.col("short"), "left")
    else:
        salted = hashed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        asked = asked.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
        joined = asked.join(
            salted, (F.col("_short") == F.col("short")) & (F.col("_salt") == F.col("salt")), "left"
        )
    confirmed = F.when(
        F.col("_digest") == F.col("digest"),
        F.struct(
            F.length("rule").alias("length"), F.col("host_len"), F.col("rule").alias("rule"), F.col("verdict")
        ),
    )
    best = joined.groupBy("_row").agg(
        *(F.any_value(c).alias(c) for c in ("_id", "_host", "_path")), F.max(confirmed).alias("_best")
    )
    return best.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
