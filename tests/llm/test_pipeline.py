"""The pipeline against a plain version: each stage's rows recomputed from the rows of the stage before."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_repeats
from vitrine.llm import mixing, outliers, packing, queries
from vitrine.llm.hyperlang import Profiles, identify_languages, train_prototypes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs))
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
    return dict(out), docs


def rows(df):
    return sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def after(stages, name):
    names = [n for n, _ in corpus_pipeline.STAGES]
    return stages[0][names[names.index(name) + 1]]


def test_quality_keeps_what_its_verdicts_keep(stages):
    docs = stages[0]["quality_rules"]
    kept = {r["doc_id"] for r in outliers.quality_verdicts(docs).where("kept").collect()}
    assert rows(after(stages, "quality_rules")) == [r for r in rows(docs) if r[0] in kept]


def fingerprint(text):
    """By the contract: 3-word shingles, repeats included, a bit set in over half the hashes."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    bits = np.array([((hashes >> np.uint64(b)) & np.uint64(1)).sum() for b in range(64)])
    return sum(1 << b for b in range(64) if 2 * int(bits[b]) > len(hashes))


def test_one_document_of_each_near_duplicate_group_stays(stages):
    docs = rows(stages[0]["simhash_near_dedup"])
    ids, fps = [r[0] for r in docs], np.array([fingerprint(r[1] or "") for r in docs], np.uint64)
    lows = brute_components(ids, fps)
    assert rows(after(stages, "simhash_near_dedup")) == [r for r, low in zip(docs, lows) if r[0] == low]


def test_repeated_passages_go(stages):
    docs = rows(stages[0]["suffix_array_dedup"])
    got = {r[0]: r for r in rows(after(stages, "suffix_array_dedup"))}
    for r, (n_bytes, removed, _, digest) in zip(docs, brute_repeats([(r[0], r[1]) for r in docs])):
        if removed == 0:
            assert got[r[0]] == r
        elif r[0] in got:
            assert got[r[0]][4] == len(got[r[0]][1]) and got[r[0]][1]
            if len(got[r[0]][1].encode()) == n_bytes - removed:  # no character was cut in two
                assert hashlib.sha256(got[r[0]][1].encode()).hexdigest() == digest
        else:
            assert n_bytes - removed < 4  # nothing, or part of one character, is left


def test_mixing_keeps_what_is_sampled(stages):
    docs = stages[0]["source_mixing"]
    chosen = {r["doc_id"] for r in mixing.sampled_mixture(docs).where("sampled").collect()}
    assert rows(after(stages, "source_mixing")) == [r for r in rows(docs) if r[0] in chosen]


def test_packing_holds_every_token_once(stages):
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows(stages[0]["best_fit_packing"])}
    got, fill = defaultdict(int), defaultdict(list)
    for r in stages[1].collect():
        got[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= queries.SEQUENCE
    assert packing.packing_gap(stages[1], queries.SEQUENCE)["gap"] == 0


def test_run_gives_the_stages_in_turn(spark, stages):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got, want = ([tuple(r[n] for n in names) for r in df.collect()] for df in (corpus_pipeline.run(spark, SF), stages[1]))
    assert sorted(got) == sorted(want)


def test_prototypes_and_predictions_against_plain_sums(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    profiles, sums = Profiles(), defaultdict(lambda: np.zeros(1024))
    listed = docs.collect()
    units = {r["doc_id"]: profiles.bundle([r["text"]])[0].astype(float) for r in listed}
    for r in listed:
        sums[r["lang"]] += units[r["doc_id"]]
    want = {lang: v / np.linalg.norm(v) for lang, v in sums.items()}
    got = train_prototypes(docs)
    assert got.keys() == want.keys() and all(np.allclose(got[x], want[x], atol=1e-4) for x in want)
    labels = sorted(want)
    matrix = np.array([want[x] for x in labels])
    for r in identify_languages(docs, got).collect():
        cosine = matrix @ units[r["doc_id"]]
        assert r["lang_pred"] == labels[int(cosine.argmax())] and abs(r["score"] - max(cosine.max(), 0)) < 1e-3
