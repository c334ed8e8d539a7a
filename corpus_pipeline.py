"""Corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; all but the last return the columns of
``documents``. Stages after a removal of text keep the ``n_chars`` column true to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import materialize
from vitrine.llm.mixing import sample_documents
from vitrine.llm.outliers import quality_verdicts
from vitrine.llm.packing import pack_best_fit, token_pieces
from vitrine.llm.queries import BIT_DISTANCE, SEQUENCE, SHINGLE, tokenizer_path
from vitrine.llm.repeats import remove_repeats
from vitrine.llm.simhash import drop_near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows of one id are judged each by its own text, language and source."""
    return quality_verdicts(docs.select(*COLUMNS), carry=True).where("kept").select("doc.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs.select(*COLUMNS), SHINGLE, BIT_DISTANCE)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated byte strings; documents of which nothing is left go."""
    cut = remove_repeats(docs.select(*COLUMNS))
    touched = F.col("n_removed") > 0
    return cut.where(~touched | (F.length("text") > 0)).select(
        "doc_id", "text", "lang", "source", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights."""
    return sample_documents(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan of the documents that are left: one row a piece."""
    pieces = token_pieces(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), SEQUENCE)
    return pack_best_fit(pieces, SEQUENCE)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # XXH64 fingerprints and byte-wise suffixes are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
