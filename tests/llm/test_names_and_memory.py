"""One table whose extra columns are names used inside, through every operator and stage; bounded memories."""

import corpus_pipeline
import pyarrow as pa
import pytest

from vitrine.llm import bpe, queries
from vitrine.llm.alignment import align_tokenizers
from vitrine.llm.collocations import mine_collocations
from vitrine.llm.common import BATCH_BYTES, TEXT_BATCH, released, small_batches
from vitrine.llm.curve_packing import pack_along_curve
from vitrine.llm.hyperlang import identify_languages, train_prototypes
from vitrine.llm.mixing import sample_documents, sampled_mixture
from vitrine.llm.outliers import quality_verdicts
from vitrine.llm.packing import pack_best_fit, token_pieces
from vitrine.llm.repeats import remove_repeats
from vitrine.llm.simhash import drop_near_duplicates, simhash_components
from vitrine.llm.token_count import count_tokens

BYTE, WORD, PIECE = (queries.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


@pytest.mark.parametrize(
    "run",
    [
        sampled_mixture, quality_verdicts, simhash_components, remove_repeats,
        lambda d: identify_languages(d, train_prototypes(d)), lambda d: count_tokens(d, BYTE),
        lambda d: align_tokenizers(d, BYTE, PIECE),
    ],
)
def test_a_row_for_every_row(odd_documents, run):
    assert run(odd_documents).count() == odd_documents.count()


def test_rows_that_stay_keep_their_columns(odd_documents):
    for run in (sample_documents, drop_near_duplicates, remove_repeats):
        got = run(odd_documents)
        assert set(odd_documents.columns) <= set(got.columns)
        assert all(r["_id"] == r["_k"] == r["_row"] == 1 for r in got.collect())


def test_packings_take_tables_with_any_columns(odd_documents):
    assert pack_along_curve(odd_documents, WORD, 2048).count() >= odd_documents.count()
    pieces = token_pieces(odd_documents, WORD, 2048)
    assert pack_best_fit(pieces.selectExpr("*", "7 AS _row", "8 AS _part"), 2048).where("_row = 7 and _part = 8").count() == pieces.count()
    assert mine_collocations(odd_documents, least=2).count() > 0


def test_every_stage(spark, odd_documents, no_documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_documents, "").count() >= 0
        assert stage(spark, no_documents, "").count() == 0


def test_chunk_memories_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 500_000)
    for reader, read in ((bpe.ByteCounter(BYTE), "count"), (bpe.WordEncoder(WORD), "encode")):
        for i in range(60):
            getattr(reader, read)("x" * 20_000 + str(i) + " tail")
        assert reader.held <= 500_000 + 2 * (5 * 21_000 + 2 * bpe.ENTRY)
        assert sum(map(len, reader.known)) <= 500_000
        if hasattr(reader, "words"):
            assert sum(map(len, reader.words)) <= 500_000


def test_a_task_leaves_its_memories_empty(spark, odd_documents):
    encoder = bpe.WordEncoder(WORD)
    ids = encoder.encode("some words and somewhatlongerwordsxyz")
    assert encoder.held and encoder.words_held
    assert list(released(iter, encoder.forget)([1, 2])) == [1, 2]
    assert not encoder.known and not encoder.words and not encoder.held and not encoder.words_held
    assert encoder.encode("some words and somewhatlongerwordsxyz") == ids
    token_pieces(odd_documents, WORD, 2048).count()
    held = spark.sparkContext.parallelize(range(8), 8).map(lambda _: bpe.word_encoder(WORD).held).collect()
    assert not any(held)


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])


@pytest.mark.parametrize(
    "run",
    [lambda d: quality_verdicts(d, carry=True), simhash_components, remove_repeats, lambda d: token_pieces(d, WORD, 2048)],
    ids=["quality", "simhash", "repeats", "pieces"],
)
def test_whole_texts_come_in_batches_of_bounded_bytes(spark, run):
    spark.conf.unset(BATCH_BYTES)
    try:
        texts = "doc_id long, text string, lang string, source string"
        run(spark.createDataFrame([(1, "a text of more than ten words " * 9, "en", "a")], texts))
        docs = spark.range(0, 2_000, 1, 1).selectExpr("id AS doc_id", "repeat('0123456789', 1000) AS text")  # 20 MB in one partition
        sizes = [r["size"] for r in docs.mapInArrow(_sizes, "size long").collect()]
        assert len(sizes) > 8 and max(sizes) <= TEXT_BATCH + 11_000
        spark.conf.set(BATCH_BYTES, "100k")
        small_batches(spark)
        assert spark.conf.get(BATCH_BYTES) == "100k"
    finally:
        spark.conf.unset(BATCH_BYTES)
