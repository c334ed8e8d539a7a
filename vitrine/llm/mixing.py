"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token weights are raked until their sums by source, by
language and by topic meet the targets, with no cell beyond the tokens it has; a cell's raked share of its
tokens is the probability with which its documents are sampled. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import WORD, free_names, materialize

DIMS = ["source", "lang", "topic"]
# Tokens to keep, as a share of all, and the power that flattens the corpus's own shares into targets (1 keeps
# them, 0 makes them equal).
BUDGET = 0.6
FLATTEN = {"source": 0.7, "lang": 0.8, "topic": 0.9}
SWEEPS = 25
TOLERANCE = 1e-3
SEED = 77
NONE = "\u0000none"  # stands for null, apart from every real value
OTHER = "prose"
# What a topic's words or signs look like; the topic with the most matches names the document, the first of equals.
TOPICS = {
    "legal": r"(?i)licen[sc]e|copyright|warrant",
    "contact": r"@[a-zA-Z]|\d{3}-\d{4}",
    "listing": r" \| ",
    "marked": r"[#*$%&<>]{3}",
}


def topic_of(text: Column, topics: dict[str, str] = TOPICS) -> Column:
    """The topic whose pattern matches most often (ties: the earlier one), or ``prose``."""
    counts = F.array(
        *[F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, (t, p) in enumerate(topics.items())]
    )
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["t"]).otherwise(OTHER)


def document_cells(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", carry: bool = False,
    topic_col: str | None = None,
) -> DataFrame:
    """``id_col, n_tokens`` (words) and the cell ``source, lang, topic`` of every row (null values become a cell value); with ``carry``
    the whole row too, as ``doc``. ``topic_col`` names a column of topic labels; without one the topic is the text's lexical register
    (``TOPICS``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []
    return docs.select(
        *whole,
        F.col(id_col).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
        F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)).alias("lang"),
        (F.coalesce(F.col(topic_col).cast("string"), F.lit(NONE)) if topic_col else topic_of(text)).alias("topic"),
    ).withColumnRenamed("id", id_col)


def flattened_targets(cells: DataFrame, dim: str, power: float, total: float) -> DataFrame:
    """``dim, target``: the corpus's token shares to the ``power``, scaled to ``total``."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
    raised = sums.select(dim, F.when(F.col("t") > 0, F.pow("t", F.lit(power))).otherwise(0.0).alias("r"))
    norm = raised.agg(F.sum("r")).first()[0] or 1.0  # one number
    return raised.select(dim, (F.col("r") / norm * total).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (the keys of ``targets`` and ``tokens``) plus ``weight``: the start (``weight``, or ``tokens``) fitted to the targets'
    sums in turn, never above ``tokens``.

    A sweep fits every dimension once; it ends when the largest change of a weight, as a share of its cell's tokens, is at most
    ``tolerance``. Where caps make the targets impossible the weights settle as near as the sweeps come; :func:`marginal_gaps` tells
    how near. Values without a target keep their weights. ``targets`` have one row a value.

    Each dimension's fit reads the weights twice, for their sums and for the new weights, so they are written to the shared folder
    after every fit: three fits in one plan hold the first one's steps several times over, and the driver all their plans.
    """
    start = cells if "weight" in cells.columns else cells.withColumn("weight", F.col("tokens").cast("double"))
    sought = dict(zip(targets, free_names(start.columns, *(f"target{i}" for i in range(len(targets))))))
    old, total, value, factor = free_names([*start.columns, *sought.values()], "old", "sum", "value", "factor")
    state = start
    for dim, target in targets.items():
        named = target.select(F.col(dim).alias(value), F.col("target").alias(sought[dim]))
        state = state.join(named, F.col(dim) == F.col(value), "left").drop(value)
    state = materialize(state, "cells")
    for _ in range(sweeps):
        now = state.withColumn(old, F.col("weight"))
        for dim, goal in sought.items():
            sums = now.groupBy(F.col(dim).alias(value)).agg(F.sum("weight").alias(total))
            fit = F.when(F.col(total) > 0, F.col(goal) / F.col(total))
            fitted = F.least(F.col("weight") * F.coalesce(factor, F.lit(1.0)), F.col("tokens").cast("double"))
            now = now.join(sums, F.col(dim) == F.col(value), "left").withColumn(factor, fit).withColumn("weight", fitted)
            now = materialize(now.drop(value, total, factor), "cells")
        change = now.agg(F.max(F.abs(F.col("weight") - F.col(old)) / F.greatest("tokens", F.lit(1)))).first()[0]
        state = now.drop(old)
        if change is None or change <= tolerance:
            break
    return state.drop(*sought.values())


def marginal_gaps(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``dimension, value, target, reached``: how near the raked ``weight`` sums come to the targets, where caps or the last sweep
    left a gap."""
    parts = []
    for dim, target in targets.items():
        sums = raked.groupBy(F.col(dim).alias("value")).agg(F.sum("weight").alias("reached"))
        named = target.select(F.col(dim).alias("value"), "target")
        parts.append(sums.join(named, "value").select(F.lit(dim).alias("dimension"), "value", "target", "reached"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def sampled_mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    budget: float = BUDGET, flatten: dict[str, float] = FLATTEN, seed: int = SEED, topic_col: str | None = None,
) -> DataFrame:
    """``id_col, n_tokens, source, lang, topic, probability, sampled`` for every row of ``docs``.

    ``probability`` is the raked share of the cell's tokens; a row is sampled if a hash of its id, cell and length falls below it,
    so a rerun decides alike and repeated rows share one decision. The budget is ``budget`` of all
    tokens; the targets are the corpus's own shares by source, language and topic, each flattened to a power.

    Null sources and languages are values of their own (shown as null); a null text has no tokens. Cells without
    tokens have probability ``budget``. Other columns are ignored; an empty table gives no rows.

    Documents are pre-aggregated to cells; the raking works on the cells' table alone. The driver sees one number
    a step.
    """
    shown = [F.when(F.col(d) != NONE, F.col(d)).alias(d) for d in DIMS]
    cells = document_cells(docs, id_col, text_col, source_col, lang_col, topic_col=topic_col)
    judged = _judged(cells, id_col, budget, flatten, seed)
    return judged.select(F.col("_id").alias(id_col), "n_tokens", *shown, "probability", "sampled")


def _judged(rows: DataFrame, id_col: str, budget: float, flatten: dict[str, float], seed: int) -> DataFrame:
    """``rows`` (of :func:`document_cells`, the id named ``_id``) plus ``probability`` and ``sampled``."""
    rows = materialize(rows.withColumnRenamed(id_col, "_id"), "mixture")
    cells = materialize(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) * budget
    targets = {d: materialize(flattened_targets(cells, d, flatten[d], total), "targets") for d in DIMS}
    start = cells.withColumn("weight", F.col("tokens") * F.lit(budget))
    raked = rake(start, targets).select(
        *(F.col(d).alias(f"_{d}") for d in DIMS),
        F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(budget)).alias("probability"),
    )
    same = (F.col("source") == F.col("_source")) & (F.col("lang") == F.col("_lang")) & (F.col("topic") == F.col("_topic"))
    luck = F.pmod(F.xxhash64("_id", *DIMS, "n_tokens", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return rows.join(raked, same).withColumn("sampled", luck < F.col("probability"))


def sample_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    budget: float = BUDGET, flatten: dict[str, float] = FLATTEN, seed: int = SEED, topic_col: str | None = None,
) -> DataFrame:
    """The rows of ``docs`` that :func:`sampled_mixture` samples, all columns as they are.

    The rows are written once with their cells beside them; the raking reads the cells' columns alone, and the join with the raked
    cells, a small table, decides each row where it is read.
    """
    rows = document_cells(docs, id_col, text_col, source_col, lang_col, carry=True, topic_col=topic_col)
    return _judged(rows, id_col, budget, flatten, seed).where("sampled").select("doc.*")
