"""Quality rules: robust multivariate outliers.

Each text gives a vector of transformed statistics. For every (language, source) the minimum-covariance-
determinant estimate (the mean and covariance of the part of the rows with the smallest determinant) is
found by concentration steps over all rows from three starts, until no determinant falls; the smallest is kept. A text far from it in
Mahalanobis distance is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import materialize, released, small_batches

# Base rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = re.compile(r"[#*$%&|<>]")
SPACES = re.compile(r"[\x20\x09-\x0D]+")

# The share of a group's rows that the estimate rests on, at least.
COVERAGE = 0.6
# Steps end when no start's log determinant falls by more than this, and in any case after MOST_STEPS (a step covers whole
# bins of distance, so determinants may go to and fro by less than a bin).
SETTLED, MOST_STEPS = 0.01, 12
# Rows that carry a covariance of five statistics. The estimate of a group with fewer is shrunk to its
# language's, and that of a language with fewer to that of all rows; the weight reaches 1 at this size.
FULL_ROWS = 25
# Of so few rows the covered part has no covariance of five statistics (six rows at least), and one bad text is much of it.
LEAST_ROWS = 9
# Fixed value: the COVERAGE quantile of a chi-square law with five degrees of freedom. A group whose covered
# distance is larger has its distances divided by the ratio.
COVERED = 5.13
# Squared distance beyond which a text is rejected. The statistics of honest texts have heavier tails
# than a normal law, so the cut is far outside its 0.999 quantile (20.5).
CUTOFF = 45.0
# Shrinks the statistics of short texts: so many words with the prior's value are added to every text.
PRIOR_WORDS = 50.0
PRIOR = {"chars": 5.0, "symbols": 0.0, "dup_lines": 0.0, "repeats": 0.0}
# No statistic counts as more regular than this (standard deviation, in the units below).
FLOOR = [1.0, 0.35, 0.05, 0.12, 0.12]
# Bins of log distance in which a concentration step counts rows; an edge of a bin is its cut.
BINS_PER_UNIT = 6

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIMS = ["z0", "z1", "z2", "z3", "z4"]


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """Words (runs of anything but ``[\\x20\\x09-\\x0D]``), their code points, symbols, lines equal to an earlier line (lines
    with a word only), and words in windows of five words that the text has twice or more."""
    if not text:
        return 0, 0, 0, 0, 0
    words = SPACES.split(text.strip(" \t\n\v\f\r"))
    if words == [""]:
        words = []
    n = len(words)
    symbols = len(SYMBOLS.findall(text))
    lines = Counter(line for line in text.split("\n") if line.strip(" \t\n\v\f\r"))
    repeats = 0
    if n > WINDOW:
        number: dict[str, int] = {}
        ids = [number.setdefault(w, len(number)) for w in words]
        windows = list(zip(*[ids[k:] for k in range(WINDOW)]))
        times = Counter(windows)
        if len(times) < len(windows):
            covered = 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeats += i + WINDOW - max(covered, i)
                    covered = i + WINDOW
    return n, sum(map(len, words)), symbols, sum(lines.values()) - len(lines), repeats


def with_statistics(docs: DataFrame, keys: list[str], text_col: str = "text", inside: str | None = None) -> DataFrame:
    """``keys`` and the statistics of every row; one narrow pass. ``text_col`` is a field of the key ``inside``, if that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(inside).field(text_col) if inside else batch.column("_text")
            found = [text_statistics(t) for t in texts.to_pylist()]
            columns = np.array(found, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), *(pa.array(c) for c in columns)], [*keys, *STATS]
            )

    small_batches(docs.sparkSession)
    src = docs.select(*keys) if inside else docs.select(*keys, F.col(text_col).alias("_text"))
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField(s, T.LongType()) for s in STATS])
    return src.mapInArrow(released(run), schema)


def _with_vector(stats: DataFrame) -> DataFrame:
    """The transformed statistics: log length, and for each word shrunk, variance-stabilised rates."""
    n = F.col("n_words") + PRIOR_WORDS
    rate = lambda c, prior: (F.col(c) + prior * PRIOR_WORDS) / n
    return stats.select(
        "*",
        F.log1p("n_words").alias("z0"),
        rate("word_chars", PRIOR["chars"]).alias("z1"),
        F.sqrt(rate("n_symbols", PRIOR["symbols"])).alias("z2"),
        F.sqrt(rate("n_dup_lines", PRIOR["dup_lines"])).alias("z3"),
        F.sqrt(rate("n_repeat_words", PRIOR["repeats"])).alias("z4"),
    )


PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
MOMENTS = [*(f"s{i}" for i in range(5)), *(f"q{i}{j}" for i, j in PAIRS)]


def _moments() -> list:
    sums = [F.sum(F.col(DIMS[i])).alias(f"s{i}") for i in range(5)]
    return [F.count("*").alias("n"), *sums, *(F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q{i}{j}") for i, j in PAIRS)]


def _distance(prefix: str = "") -> F.Column:
    """Squared Mahalanobis distance from the row's estimate (columns ``m0..`` and the inverse's ``p00..``)."""
    d = [F.col(DIMS[i]) - F.col(f"{prefix}m{i}") for i in range(5)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + F.col(f"{prefix}p{i}{j}") * d[i] * d[j] * (1.0 if i == j else 2.0)
    return total


ESTIMATE = [*(f"m{i}" for i in range(5)), *(f"p{i}{j}" for i, j in PAIRS)]


def _estimate(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, inverse covariance and its log determinant of each row of moments (one row a group and start)."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema.fields if f.name in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            mean = np.stack([batch.column(f"s{i}").to_numpy(zero_copy_only=False) / n for i in range(5)], axis=1)
            inverse = np.zeros((len(n), 5, 5))
            cov = np.zeros((len(n), 5, 5))
            for i, j in PAIRS:
                q = batch.column(f"q{i}{j}").to_numpy(zero_copy_only=False) / n - mean[:, i] * mean[:, j]
                cov[:, i, j] = cov[:, j, i] = q
            if len(n):
                # The floor keeps statistics that are all alike from making any other value infinitely far.
                cov = cov + np.diag(np.square(FLOOR))
                inverse = np.linalg.inv(cov)
            logdet = np.linalg.slogdet(cov)[1] if len(n) else n
            columns = [batch.column(k) for k in keys]
            columns += [pa.array(mean[:, i]) for i in range(5)] + [pa.array(inverse[:, i, j]) for i, j in PAIRS]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(logdet)], [*keys, *ESTIMATE, "logdet"])

    return moments.mapInArrow(run, ", ".join([*kinds, *(f"{c} double" for c in ESTIMATE), "logdet double"]))


def _starts(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Three first estimates of each group, told apart by ``_start``: coordinate medians and scaled quartile ranges (a sketch's, so
    mergeable); the moments of the rows drawn in towards these medians (the hyperbolic tangent of the scaled statistics); and the moments
    of all rows."""
    quart = [F.percentile_approx(d, [0.25, 0.5, 0.75], 1000).alias(f"r{i}") for i, d in enumerate(DIMS)]
    rows = vectors.groupBy(*keys).agg(*quart)
    scale = [F.pow((F.col(f"r{i}")[2] - F.col(f"r{i}")[0]) / 1.349, 2) + FLOOR[i] ** 2 for i in range(5)]
    inverse = [(1.0 / scale[i] if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in PAIRS]
    medians = rows.select(*keys, *(F.col(f"r{i}")[1].alias(f"m{i}") for i in range(5)), *inverse)
    medians = materialize(medians.withColumn("_start", F.lit(0)), "start")
    near = _join(vectors, medians, keys)
    drawn = [
        (F.col(f"m{i}") + F.tanh((F.col(d) - F.col(f"m{i}")) * F.sqrt(f"p{i}{i}")) / F.sqrt(f"p{i}{i}")).alias(d)
        for i, d in enumerate(DIMS)
    ]
    near = near.select(*keys, *drawn, F.lit(1).alias("_start"))
    both = near.unionAll(vectors.select(*keys, *DIMS, F.lit(2).alias("_start")))
    found = _estimate(both.groupBy(*keys, "_start").agg(*_moments()), [*keys, "_start"]).drop("logdet")
    return materialize(medians.unionByName(found), "starts")


def _concentrate(vectors: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    """One concentration step of every start: the moments of each group's rows within the smallest bin edge that covers
    ``COVERAGE`` of them, and that edge. Rows are pre-aggregated into (group, start, distance bin) first."""
    dist = _join(vectors, estimate, keys).withColumn("_d2", _distance())
    bin_ = F.floor(F.log(F.greatest(F.col("_d2"), F.lit(1e-3))) * BINS_PER_UNIT).cast("int")
    by = [*keys, "_start"]
    binned = dist.groupBy(*by, bin_.alias("_bin")).agg(*_moments())
    order = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    kept = binned.withColumn("_before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn(
        "_all", F.sum("n").over(whole)
    )
    kept = kept.where(F.col("_before") < F.lit(COVERAGE) * F.col("_all"))
    sums = [F.sum(c).alias(c) for c in ["n", *MOMENTS]]
    return kept.groupBy(*by).agg(*sums, F.exp((F.max("_bin") + 1) / float(BINS_PER_UNIT)).alias("edge"))


def _join(rows: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's estimate; the groups' table is small and Spark broadcasts or splits by measured size."""
    named = estimate.select(*(F.col(k).alias(f"_e_{k}") for k in keys), *[c for c in estimate.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    return rows.join(named, cond).drop(*(f"_e_{k}" for k in keys))


def robust_estimates(vectors: DataFrame, keys: list[str], most_steps: int = MOST_STEPS) -> DataFrame:
    """``keys, m0.., p00.., logdet, edge``: mean and inverse covariance of the covered rows of each group, the log of the covariance's
    determinant, and the squared distance that covers ``COVERAGE`` of the group.

    All starts take their steps together, a step is one aggregate of all rows; the driver sees one number a step, the
    largest fall of a determinant. The start with the smallest determinant is the group's estimate.
    """
    by = [*keys, "_start"]
    estimate, before = _starts(vectors, keys), None
    for _ in range(most_steps):
        estimate = materialize(_estimate(_concentrate(vectors, estimate, keys), by), "estimate")
        if before is not None:
            was = before.select(*keys, "_start", F.col("logdet").alias("_was"))
            fall = _join(estimate, was, by).agg(F.max(F.col("_was") - F.col("logdet"))).first()[0]
            if fall is None or fall <= SETTLED:
                break
        before = estimate
    best = estimate.groupBy(*keys).agg(F.min_by(F.struct(*ESTIMATE, "logdet", "_start"), F.struct("logdet", "_start")).alias("e"))
    best = materialize(best.select(*keys, "e.*"), "estimate")
    edge = _concentrate(vectors, best, keys).select(*keys, "edge")
    return materialize(_join(best.drop("_start"), edge, keys), "estimate")


def own_weight(n: np.ndarray) -> np.ndarray:
    """How much a group's own estimate counts: n / (n + k) of its rows beyond ``LEAST_ROWS``, scaled so that it reaches 1 at ``FULL_ROWS`` without a step."""
    more, k = np.maximum(n - LEAST_ROWS, 0.0), FULL_ROWS - LEAST_ROWS
    return np.minimum(2.0 * more / (more + k), 1.0)


def _shrunk(groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """``_lang, _source, m0.., p00.., edge`` of every group: its own estimate mixed with its language's, that with the estimate of
    all rows. First and second moments are mixed, so a distance between the means widens the covariance."""
    columns = [*ESTIMATE, "edge"]
    joined = groups
    for level, on in enumerate((("_lang", "_source"), ("_lang",), ())):
        named = estimates.where(F.col("_level") == level).select(
            F.col("_g_lang").alias("_e_lang"), F.col("_g_source").alias("_e_source"), *(F.col(c).alias(f"{c}_{level}") for c in columns)
        )
        cond = F.lit(True)
        for k in on:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_e{k}"))
        joined = joined.join(named if on else F.broadcast(named), cond, "left").drop("_e_lang", "_e_source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            mean = second = edge = None
            for level, size in ((2, None), (1, "_nl"), (0, "_n")):
                m = np.stack([get(f"m{i}_{level}") for i in range(5)], axis=1)
                inverse = np.tile(np.eye(5), (len(m), 1, 1))
                for i, j in PAIRS:
                    inverse[:, i, j] = inverse[:, j, i] = get(f"p{i}{j}_{level}")
                known = ~np.isnan(m[:, 0])  # the wider levels are missing where they have no weight
                inverse[~known] = np.eye(5)
                q = np.linalg.inv(inverse) + m[:, :, None] * m[:, None, :]
                e = get(f"edge_{level}")
                if size is None:
                    mean, second, edge = m, q, e
                    continue
                w = own_weight(get(size))
                pick = lambda own, wide: np.where(
                    (w == 1).reshape(-1, *[1] * (own.ndim - 1)), own,
                    w.reshape(-1, *[1] * (own.ndim - 1)) * own + (1 - w).reshape(-1, *[1] * (own.ndim - 1)) * wide,
                )
                mean, second, edge = pick(m, mean), pick(q, second), pick(e, edge)
            inverse = np.linalg.inv(second - mean[:, :, None] * mean[:, None, :]) if len(mean) else second
            out = [pa.array(mean[:, i]) for i in range(5)] + [pa.array(inverse[:, i, j]) for i, j in PAIRS] + [pa.array(edge)]
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), batch.column("_source"), *out], ["_lang", "_source", *columns])

    kinds = [f"{k} {groups.schema[k].dataType.simpleString()}" for k in ("_lang", "_source")]
    return materialize(joined.mapInArrow(run, ", ".join([*kinds, *(f"{c} double" for c in columns)])), "estimates")


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", cutoff: float = CUTOFF, carry: bool = False,
) -> DataFrame:
    """``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept`` for every row; with
    ``carry`` the whole row too, as ``doc``, so that a filter on the verdict needs no join.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in five-word windows that occur
    twice. Other rows are kept unless their squared Mahalanobis distance from the robust estimate of
    their (language, source) passes ``cutoff`` (see ``COVERED`` for groups that are wider than a normal law). The estimate of a group
    with fewer than ``FULL_ROWS`` such rows is shrunk smoothly to its language's, and that of a language with fewer to that of all rows. Null languages and sources are groups of their own.

    Null texts have no words and fail; repeated rows are judged as often as they come; other columns are
    ignored; an empty table gives no rows. Estimates rest on all rows that pass the base rules. A hot group is
    many partial sums; the driver sees nothing.
    """
    src = docs.select(
        F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc") if carry else F.col(text_col).alias("text"),
    )
    whole = ["doc"] if carry else []
    stats = with_statistics(src, ["_id", "_lang", "_source", *whole], text_col if carry else "text", "doc" if carry else None)
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    )
    stats = materialize(_with_vector(stats.withColumn("base_failed", failed)), "statistics")
    passed = stats.where(~F.col("base_failed"))
    sizes = passed.groupBy("_lang", "_source").agg(F.count("*").alias("_n"))
    by_lang = sizes.groupBy("_lang").agg(F.sum("_n").alias("_nl"), F.min("_n").alias("_least"))
    named = by_lang.withColumnRenamed("_lang", "_l")
    groups = materialize(sizes.join(named, F.col("_lang").eqNullSafe(F.col("_l"))).drop("_l"), "groups")
    # Each row takes part in the estimate of its group (level 0) and, where a smaller group needs them, of its language (1) and of all rows (2).
    keys = ["_level", "_g_lang", "_g_source"]
    group_keys = [
        F.when(F.col("_level") < 2, F.col("_lang")).alias("_g_lang"), F.when(F.col("_level") < 1, F.col("_source")).alias("_g_source")
    ]
    used = F.when(F.col("_least") >= FULL_ROWS, F.array(F.lit(0))).when(F.col("_nl") >= FULL_ROWS, F.array(F.lit(0), F.lit(1)))
    used = used.otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    # Written, since every concentration step reads it.
    needed = materialize(groups.select(F.explode(used).alias("_level"), "_lang", "_source").select("_level", *group_keys).distinct(), "groups")
    # A row takes part in the wider levels only where a group needs them.
    vectors = None
    for level in sorted(r[0] for r in needed.select("_level").distinct().collect()) or [0]:
        rows = passed.select(F.lit(level).alias("_level"), "_lang", "_source", *DIMS).select("_level", *group_keys, *DIMS)
        rows = _join(rows, needed.where(F.col("_level") == level), keys) if level else rows
        vectors = rows if vectors is None else vectors.unionAll(rows)
    estimates = _shrunk(groups, robust_estimates(vectors, keys))
    named = estimates.select(F.col("_lang").alias("_gl"), F.col("_source").alias("_gs"), *ESTIMATE, "edge")
    cond = F.col("_lang").eqNullSafe(F.col("_gl")) & F.col("_source").eqNullSafe(F.col("_gs"))
    scored = stats.join(named, cond, "left").withColumn("distance", _distance() / F.greatest(F.col("edge") / COVERED, F.lit(1.0)))
    return scored.select(
        *whole, F.col("_id").alias(id_col), *STATS, "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
    )
