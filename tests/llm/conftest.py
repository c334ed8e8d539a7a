"""Tables shared by the operator tests."""

import random

import pytest

SF = "/root/testdata/sf0.001"
# Every name an operator uses inside is an extra column here.
EXTRA = [
    "id", "key", "h", "label", "_row", "_id", "_k", "_h", "n", "ids", "part", "place", "kept", "row", "doc", "word", "phrase", "a", "l",
    "r", "score", "lang_pred", "fp", "keys", "mults", "pair", "weight", "cell", "piece", "start", "length", "sequence_id", "offset",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in EXTRA)


@pytest.fixture(scope="package")
def sf_documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="package")
def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that the operators use inside."""
    passage = "the quick brown fox jumps over the lazy dog while seven wizards quietly box up forty jugs of liquor " * 2
    rnd = random.Random(3)
    long_text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(30_000))
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, "   \n\t ", "en", "a"), (4, passage, "en", "a"),
        (4, passage, "en", "a"), (5, passage, "en", None), (5, "same id, another text " * 9, "en", "b"),
        (None, "no id " * 40, None, "b"), (6, long_text, "xx", "b"), (7, "été " * 60 + "ça va? ﬁ İstanbul ΑΣ", "fr", "b"),
        (8, "a" * 500, "en", "b"), (9, "<|endoftext|> it's   odd   spacing here 12345", "en", "b"), (10, "日本語 テキスト", "ja", "b"),
        (11, "▁ a piece▁sign", "en", "b"), (12, "nul \x00 and </s> <0x41> \U0001f600\U0001f468‍\U0001f469 ", "en", "b"),
        (13, " ", "en", "b"), (14, "x\n y \t z  ", "en", "b"),
    ]
    return spark.createDataFrame([(*r, 0, *[1] * len(EXTRA)) for r in rows], SCHEMA)


@pytest.fixture(scope="package")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
