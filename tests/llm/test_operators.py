"""Every operator against brute force on a small table, and on hostile rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, duck_connection
from vitrine.llm import bpe, hyperlang, mixing, outliers, packing, queries, repeats, simhash, topk
from vitrine.llm.common import connected_components
from vitrine.llm.html_tree import extract_main_text, low_branches, main_text, style_tree
from vitrine.llm.token_count import count_tokens
from vitrine.llm.url_rules import match_url_rules

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, h long, label int"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with names that the operators use inside."""
    passage = "the quick brown fox jumps over the lazy dog while seven wizards quietly box up forty jugs of liquor " * 2
    rnd = random.Random(3)
    long_text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(30_000))
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, "   \n\t ", "en", "a"), (4, passage, "en", "a"),
        (4, passage, "en", "a"), (5, passage, "en", None), (5, "same id, another text " * 9, "en", "b"),
        (None, "no id " * 40, None, "b"), (6, long_text, "xx", "b"), (7, "été " * 60 + "ça va? ﬁ İstanbul ΑΣ", "fr", "b"),
        (8, "a" * 500, "en", "b"), (9, "<|endoftext|> it's   odd \u2028 spacing\u00a0here 12345", "en", "b"), (10, "日本語 テキスト", "ja", "b"),
    ]
    return spark.createDataFrame([(*r, 0, 1, "k", 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- tokenizers


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", bpe.ByteCounter), ("word_bpe_49k.json", bpe.WordEncoder)])
def test_usual_characters_agree_with_the_library(name, kind):
    reader = kind(queries.tokenizer_path(name))
    for c in map(chr, [*range(0x250), *range(0x2010, 0x2028), 0x20AC]):
        for text in (c, f"a{c}b 1{c}2 !{c}? {c}{c} x  {c} y\n{c} z {c}  \n   q{c}", f"It{c}s you'LL {c}'s"):
            ids = reader.ids(text)
            if kind is bpe.ByteCounter:
                assert reader.count(text) == len(ids), text
            else:
                assert reader.encode(text) == np.array(ids, "<u4").tobytes(), text


def test_token_counts(documents, hostile, nothing):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = bpe.ByteCounter(path)
    for df in (documents, hostile):
        want = sorted((str(i), len((t or "").encode()), len(library.ids(t or ""))) for i, t in texts_of(df))
        got = rows_of(count_tokens(df, path, limit=100))
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert count_tokens(nothing, path).count() == 0


def test_packing(documents, hostile, nothing):
    path = queries.tokenizer_path("word_bpe_49k.json")
    library = bpe.WordEncoder(path)
    for df in (documents, hostile):
        pieces = packing.token_pieces(df, path, 256, with_ids=True)
        got = rows_of(packing.pack_best_fit(pieces, 256))
        want = sorted((str(i), [*library.ids(t or ""), 0]) for i, t in texts_of(df))
        tokens = {}
        for r in got:
            assert len(r["ids"]) == 4 * r["length"] and r["start"] == 256 * r["piece"]
            tokens.setdefault(str(r["doc_id"]), []).extend(np.frombuffer(r["ids"], "<u4").tolist())
        joined = {}
        for i, ids in want:
            joined.setdefault(i, []).extend(ids)
        assert {k: sorted(v) for k, v in tokens.items()} == {k: sorted(v) for k, v in joined.items()}
        bins = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 256
        bound = packing.dual_feasible_bound(np.bincount([r["length"] for r in got], minlength=257), 256)
        assert bound <= len(bins) <= bound + 2
    assert packing.pack_best_fit(packing.token_pieces(nothing, path, 256), 256).count() == 0


def test_exchange_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_PARTITION", 40)
    rnd = random.Random(1)
    pieces = spark.createDataFrame([(i, rnd.randint(1, 100)) for i in range(600)], "n long, length long")
    got = rows_of(packing.pack_best_fit(pieces, 100))
    assert sorted(r["n"] for r in got) == list(range(600))
    bound = packing.dual_feasible_bound(np.bincount([r["length"] for r in got], minlength=101), 100)
    assert len({r["sequence_id"] for r in got}) <= 1.05 * bound


def test_certified_partitions_keep_their_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_PARTITION", 40)
    dealt = []
    monkeypatch.setattr(packing, "_summary", lambda packed, keep=packing._summary: dealt.append(packed.collect()) or keep(packed))
    rnd = random.Random(2)
    pieces = spark.createDataFrame([(i, rnd.choice([30, 35, 50, 51, 70])) for i in range(500)], "n long, length long")
    packed = packing.pack_best_fit(pieces, 100)
    gap = packing.packing_gap(packed, 100)
    assert gap["sequences"] == len({r["sequence_id"] for r in packed.collect()}) and gap["gap"] >= 0
    # Of a certified partition one bin at most takes part in the next exchange.
    again, parts = {r["_row"] for r in dealt[1]}, {}
    for r in dealt[0]:
        parts.setdefault(r["_part"], []).append(r)
    certified = [rows for rows in parts.values() if len({r["sequence_id"] for r in rows}) == rows[0]["_bound"]]
    assert certified
    for rows in certified:
        assert len({r["sequence_id"] for r in rows if r["_row"] in again}) <= 1


def test_one_partition_ends_the_exchange(spark):
    rnd = random.Random(4)
    pieces = spark.createDataFrame([(i, rnd.randint(34, 66)) for i in range(300)], "n long, length long")
    packed = packing.pack_best_fit(pieces, 100)
    _, _, fills = packing.best_fit_decreasing(np.array([r["length"] for r in pieces.collect()]), 100)
    assert packing.packing_gap(packed, 100)["sequences"] == len(fills)


def test_dual_feasible_bound_is_a_lower_bound():
    for seed in range(30):
        rnd = random.Random(seed)
        sizes = np.array([rnd.randint(1, 50) for _ in range(rnd.randint(1, 60))])
        _, _, fills = packing.best_fit_decreasing(sizes, 50)
        assert packing.dual_feasible_bound(np.bincount(sizes, minlength=51), 50) <= len(fills)
    assert packing.dual_feasible_bound(np.bincount([26] * 7, minlength=51), 50) == 7


# ---------------------------------------------------------------- near-duplicates


def brute_components(ids, fps, radius=3):
    label = list(range(len(ids)))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    for i, j in zip(*np.nonzero(near)):
        a, b = label[i], label[j]
        if a != b:
            label = [a if x == b else x for x in label]
    low = {}
    for x, i in zip(label, ids):
        low[x] = min(low.get(x, i), i, key=lambda v: (v is None, v or 0))
    return [low[x] for x in label]


@pytest.mark.parametrize("block", [4096, 4])
def test_simhash(documents, hostile, nothing, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL", 2 if block == 4 else 32)
    for df in (documents, hostile):
        pairs = texts_of(df)
        fps = np.array([simhash.simhash(t, 3) for _, t in pairs], np.uint64)
        want = sorted((str(i), int(f), str(c)) for (i, _), f, c in zip(pairs, fps, brute_components([i for i, _ in pairs], fps)))
        got = rows_of(simhash.simhash_components(df))
        assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in got) == want
    assert simhash.simhash_components(nothing).count() == 0
    for df in (documents, hostile):
        pairs = sorted(set(texts_of(df)), key=lambda p: (p[0] is None, p[0] or 0))
        fps = np.array([simhash.simhash(t, 3) for _, t in pairs], np.uint64)
        groups = brute_components(list(range(len(pairs))), fps)  # named by their first row
        got = texts_of(simhash.drop_near_duplicates(df))
        place = {p: k for k, p in enumerate(pairs)}
        assert sorted(groups[place[p]] for p in got) == sorted(set(groups))
        first = {g: pairs[g][0] for g in groups}
        assert all(p[0] == first[groups[place[p]]] for p in got)
    assert simhash.drop_near_duplicates(nothing).count() == 0


def test_block_links_lose_nothing():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fps = []
    for x in base:
        for _ in range(12):
            y = int(x)
            for _ in range(rng.integers(0, 5)):
                y ^= 1 << int(rng.integers(64))
            fps.append(y)
    fps = np.unique(np.array(fps, np.uint64))
    want = brute_components(list(range(len(fps))), fps)
    label = list(range(len(fps)))
    for i, j in simhash.link_block(fps, None, 3):
        a, b = sorted((label[i], label[j]))
        label = [a if x == b else x for x in label]
    assert label == want


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in rows_of(connected_components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ---------------------------------------------------------------- repeats


def brute_repeats(pairs, span=100):
    order = sorted({(-(1 << 63) if i is None else i, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in pairs})
    seen, out = set(), {}
    for i, digest, text in order:
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - span + 1):
            w = data[p : p + span]
            if w in seen:
                gone[p : p + span] = b"\1" * span
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i, digest] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return [out[-(1 << 63) if i is None else i, hashlib.sha256((t or "").encode()).hexdigest()] for i, t in pairs]


@pytest.mark.parametrize("hot", [100_000, 1])
def test_repeats(documents, hostile, nothing, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    for df in (documents, hostile):
        pairs = texts_of(df)
        want = sorted((str(i), *w) for (i, _), w in zip(pairs, brute_repeats(pairs)))
        got = rows_of(repeats.remove_repeats(df))
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert repeats.remove_repeats(nothing).count() == 0


def test_texts_forced_to_one_number_lose_nothing(documents, monkeypatch):
    monkeypatch.setattr(repeats, "NUMBER_DIGITS", 1)
    pairs = texts_of(documents)
    want = sorted((str(i), *w) for (i, _), w in zip(pairs, brute_repeats(pairs)))
    got = rows_of(repeats.remove_repeats(documents))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_strings_of_a_hot_anchor_are_never_held_as_a_bucket(monkeypatch):
    """A line in many contexts that differ in a few bytes at its edges: one row a string, nothing to refine."""
    import pyarrow as pa

    rnd = random.Random(9)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(110))
    texts = [f"{rnd.randrange(10**9):09d} {rnd.choice('xyz')}{line}{rnd.choice('uvw')} {k:06d}" for k in range(400)]
    monkeypatch.setattr(repeats, "STRINGS", 6000)
    columns = {"id": [], "doc": [], "text": [], "places": [], "hot": []}
    for k in rnd.sample(range(400), 400):
        places = [int(p) for part in repeats.document_anchors(texts[k].encode(), 100, 40) for p in part[0]]
        for name, value in zip(columns, (k, 1000 + k, texts[k], places, places)):
            columns[name].append(value)
    tasks = [pa.RecordBatch.from_pydict({n: c[at : at + 100] for n, c in columns.items()}) for at in range(0, 400, 100)]
    rows = [r for task in tasks for b in repeats._context_rows(100, 40)(iter([task])) for r in b.to_pylist()]
    strings = [r["bytes"] for r in rows if r["bytes"] is not None]
    assert all(len(b) == 100 for b in strings)
    assert max(map(strings.count, set(strings))) <= 8  # a partial row each time a task lets its strings go
    monkeypatch.setattr(repeats, "refine", lambda *a: pytest.fail("a bucket was held"))
    rows.sort(key=lambda r: r["key"])
    batches = [pa.RecordBatch.from_pylist(rows[at : at + 500], pa.schema([*((n, pa.int64()) for n in ("key", "id", "doc", "place", "first", "last")), ("bytes", pa.binary())])) for at in range(0, len(rows), 500)]
    gone = {}
    for b in repeats._repeat_rows(100)(iter(batches)):
        for r in b.to_pylist():
            gone.setdefault(r["id"], []).append((r["start"], r["end"]))
    want = brute_repeats(list(enumerate(texts)))
    assert [sum(b - a for a, b in repeats.merge_spans(gone.get(k, []))) for k in range(400)] == [w[1] for w in want]


# ---------------------------------------------------------------- quality, language, mixing


def test_statistics_against_the_definitions(documents):
    for _, text in texts_of(documents):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(words) < 400 else None
        n, chars, symbols, dup, rep = outliers.text_statistics(text)
        assert (n, chars, symbols) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"))
        seen, again = set(), 0
        for line in text.split("\n"):
            if line.strip(" \t\n\v\f\r"):
                again += line in seen
                seen.add(line)
        assert dup == again
        if inside is not None:
            assert rep == len(inside)


def test_quality_verdicts(spark, documents, hostile, nothing):
    got = {r["doc_id"]: r for r in rows_of(outliers.quality_verdicts(documents))}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [i for i in labels if not got[i]["base_failed"]]
    assert all(got[i]["kept"] for i in judged if labels[i] == 1)
    bad = [got[i]["kept"] for i in judged if labels[i] == 0]
    assert sum(bad) <= 0.1 * len(bad)
    assert all(not r["kept"] for r in got.values() if r["base_failed"])
    rows = rows_of(outliers.quality_verdicts(hostile))
    assert len(rows) == hostile.count() and all(r["base_failed"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert outliers.quality_verdicts(nothing).count() == 0


def test_concentration_steps_match_numpy(spark):
    rng = np.random.default_rng(4)
    good, far = rng.normal(size=(900, 5)), rng.normal(size=(100, 5)) + 12
    data = np.concatenate([good, far])
    df = spark.createDataFrame([(0, *map(float, r)) for r in data], "g int, z0 double, z1 double, z2 double, z3 double, z4 double")
    r = outliers.robust_estimates(df, ["g"]).first()
    mean = np.array([r[f"m{i}"] for i in range(5)])
    assert np.abs(mean).max() < 0.2  # the outliers do not move it
    inverse = np.zeros((5, 5))
    for i, j in outliers.PAIRS:
        inverse[i, j] = inverse[j, i] = r[f"p{i}{j}"]
    d = np.einsum("ij,jk,ik->i", data - mean, inverse, data - mean)
    assert d[900:].min() > d[:900].max()


@pytest.mark.parametrize("seed", range(4))
def test_smallest_determinant_against_every_subset(spark, seed):
    """Of 12 rows the estimate covers the 8 with the smallest determinant of all 495 subsets."""
    from itertools import combinations

    rng = np.random.default_rng(seed)
    spread = np.array([9.0, 4.0, 1.0, 1.0, 1.0])
    data = np.concatenate([rng.normal(size=(8, 5)) * spread, rng.normal(size=(4, 5)) * spread + rng.choice([-90, 90], (4, 5))])
    floor = np.diag(np.square(outliers.FLOOR))
    logdet = lambda rows: np.linalg.slogdet(np.cov(data[list(rows)].T, bias=True) + floor)[1]
    best = min(combinations(range(12), 8), key=logdet)
    rows = [(0, *map(float, r)) for r in data]
    r = outliers.robust_estimates(spark.createDataFrame(rows, "g int, z0 double, z1 double, z2 double, z3 double, z4 double"), ["g"]).first()
    assert abs(r["logdet"] - logdet(best)) < 1e-6
    assert np.allclose([r[f"m{i}"] for i in range(5)], data[list(best)].mean(axis=0))


def test_the_best_start_wins(spark):
    """Two clusters: from some starts the steps settle on the wide one, the tight one has the smaller determinant."""
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(size=(640, 5)) * 0.5, rng.normal(size=(360, 5)) * 6 + 25])
    df = spark.createDataFrame([(0, *map(float, r)) for r in data], "g int, z0 double, z1 double, z2 double, z3 double, z4 double")
    r = outliers.robust_estimates(df, ["g"]).first()
    assert max(abs(r[f"m{i}"]) for i in range(5)) < 0.2
    steps = outliers._starts(df, ["g"])
    found = []
    for _ in range(8):
        steps = outliers._estimate(outliers._concentrate(df, steps, ["g"]), ["g", "_start"])
        steps = outliers.materialize(steps, "steps")
        found.append({x["_start"]: x["logdet"] for x in steps.collect()})
    assert set(found[-1]) == {0, 1, 2}
    assert r["logdet"] <= min(found[-1].values()) + 5 * outliers.SETTLED


def test_a_small_source_is_judged_by_its_own_texts(spark):
    rnd = random.Random(8)

    def text(low, high):
        return " ".join("".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(low, high))) for _ in range(rnd.randint(80, 120)))

    rows = []
    for k in range(600):  # texts of short and of long words
        n = rnd.randint(2, 14)
        rows.append((k, text(n, n + 1), "xx", "hot"))
    rows += [(1000 + k, text(4, 6), "xx", "rare") for k in range(60)] + [(2000, text(12, 13), "xx", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in rows_of(outliers.quality_verdicts(docs))}
    assert not got[2000]["kept"]
    assert all(r["kept"] for i, r in got.items() if i != 2000)
    weights = outliers.own_weight(np.arange(1, 200))
    assert (np.diff(weights) >= 0).all() and np.diff(weights).max() < 0.13 and weights[8] == 0 and (weights[24:] == 1).all()


def test_language_id(spark, documents, hostile, nothing):
    train = documents.where(~hyperlang.held_out(F.col("doc_id")))
    prototypes = hyperlang.train_prototypes(train)
    got = {r["doc_id"]: r for r in rows_of(hyperlang.identify_languages(documents, prototypes))}
    rest = documents.where(hyperlang.held_out(F.col("doc_id"))).collect()
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rest) >= 0.97 * len(rest)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    rows = rows_of(hyperlang.identify_languages(hostile, prototypes))
    assert len(rows) == hostile.count() and all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (1, 2, 3))
    assert {r["lang_pred"] for r in rows_of(hyperlang.identify_languages(hostile, {}))} == {"und"}
    assert hyperlang.train_prototypes(nothing) == {} and hyperlang.identify_languages(nothing, prototypes).count() == 0


def test_raking_meets_the_targets(spark):
    rnd = random.Random(5)
    rows = [(s, l, t, rnd.randint(500, 5000)) for s in "abcd" for l in "xyz" for t in "pq"]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    total = sum(r[3] for r in rows)
    targets = {d: mixing.flattened_targets(cells, d, p, 0.4 * total) for d, p in (("source", 0.7), ("lang", 0.8), ("topic", 0.9))}
    fitted = mixing.rake(cells.withColumn("weight", F.col("tokens") * 0.4), targets, tolerance=1e-7)
    for dim, target in targets.items():
        want = {r[dim]: r["target"] for r in target.collect()}
        have = {r[dim]: r["w"] for r in fitted.groupBy(dim).agg(F.sum("weight").alias("w")).collect()}
        assert have == pytest.approx(want, rel=1e-3)
    # The same fit in numpy.
    w = {r[:3]: 0.4 * r[3] for r in rows}
    for _ in range(50):
        for k, dim in enumerate(("source", "lang", "topic")):
            want = {r[dim]: r["target"] for r in targets[dim].collect()} if _ == 0 else wants[dim]  # noqa: F821
            wants = {**(wants if _ or k else {}), dim: want}
            for v, t in want.items():
                f = t / sum(x for c, x in w.items() if c[k] == v)
                w = {c: x * f if c[k] == v else x for c, x in w.items()}
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in fitted.collect()}
    assert got == pytest.approx(w, rel=1e-3)


def test_gaps_of_targets_that_caps_make_impossible(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("b", "x", 900)], "source string, lang string, tokens long")
    targets = {
        "source": spark.createDataFrame([("a", 300.0), ("b", 300.0)], "source string, target double"),
        "lang": spark.createDataFrame([("x", 400.0)], "lang string, target double"),
    }
    raked = mixing.rake(cells, targets)
    gaps = {(r["dimension"], r["value"]): r["reached"] - r["target"] for r in mixing.marginal_gaps(raked, targets).collect()}
    assert gaps["source", "a"] <= -200 + 1e-6 and abs(gaps["lang", "x"]) < 1


def test_concentration_steps_read_the_needed_groups_as_written(documents, monkeypatch):
    plans, write = [], outliers.materialize

    def written(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(outliers, "materialize", written)
    assert outliers.quality_verdicts(documents).count() == documents.count()
    assert sum("Generate" in p for _, p in plans) == 1 and not any("Generate" in p for name, p in plans if name == "estimate")


def test_a_sweep_holds_few_plans(spark, monkeypatch):
    """A plan that is written while raking reads the weights twice and joins once; the driver keeps every plan and what it broadcasts."""
    cells = spark.createDataFrame([(s, l, t, 500 + ord(s)) for s in "abcd" for l in "xyz" for t in "pq"], "source string, lang string, topic string, tokens long")
    targets = {d: mixing.materialize(mixing.flattened_targets(cells, d, 0.5, 5000.0), "targets") for d in ("source", "lang", "topic")}
    cells, plans, write = mixing.materialize(cells, "cells"), [], mixing.materialize

    def written(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(mixing, "materialize", written)
    raked = mixing.rake(cells, targets, sweeps=2, tolerance=0.0)
    assert raked.columns == ["source", "lang", "topic", "tokens", "weight"]
    assert max(p.count("Relation [") for p in plans) <= 1 + len(targets)
    assert all(p.count("Join ") <= 1 and p.count("Relation [") <= 2 for p in plans[1:])


def test_raking_leaves_values_without_a_target_and_takes_any_columns(spark):
    rows = [("a", "x", 100, 1), (None, "x", 100, 1), ("b", None, 0, 1), ("c", "y", 100, 1)]
    cells = spark.createDataFrame(rows, "source string, lang string, tokens long, _sum long").withColumn("_value", F.lit(2))
    targets = {"source": spark.createDataFrame([("a", 50.0), ("b", 5.0), ("z", 9.0)], "source string, target double")}
    got = {(r["source"], r["lang"]): (r["weight"], r["_sum"], r["_value"]) for r in mixing.rake(cells, targets).collect()}
    assert got == {("a", "x"): (50.0, 1, 2), (None, "x"): (100.0, 1, 2), ("b", None): (0.0, 1, 2), ("c", "y"): (100.0, 1, 2)}


def test_topic_labels_as_an_argument(spark):
    rows = [(i, "one two three", "en", "s", "sport" if i % 3 else None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    got = {r["topic"] for r in mixing.sampled_mixture(docs, topic_col="subject").collect()}
    assert got == {"sport", None}
    assert set(mixing.sample_documents(docs, topic_col="subject").columns) == set(docs.columns)


def test_mixture(documents, hostile, nothing):
    got = rows_of(mixing.sampled_mixture(documents))
    assert len(got) == documents.count() and all(0 <= r["probability"] <= 1 for r in got)
    total, kept = sum(r["n_tokens"] for r in got), sum(r["n_tokens"] * r["probability"] for r in got)
    assert kept == pytest.approx(mixing.BUDGET * total, rel=0.02)
    assert len(rows_of(mixing.sampled_mixture(hostile))) == hostile.count()
    assert mixing.sampled_mixture(nothing).count() == 0
    sample = mixing.sample_documents(documents)
    assert sample.columns == documents.columns
    assert {r["doc_id"] for r in sample.collect()} == {r["doc_id"] for r in got if r["sampled"]}


# ---------------------------------------------------------------- search, pages


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    ok, message = compare(queries.queries()[name](spark, SF), duck_connection(SF), queries.oracle_sql()[name])
    assert ok, message


def test_top_k_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.25, 0.5, 1.0]) for _ in range(6)]) for i in range(300)]
    bad = [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (305, [1.0])]
    df = spark.createDataFrame(rows + bad + rows[:20], "vec_id long, embedding array<float>")
    got = {}
    for r in rows_of(topk.exact_top_k(df, df.where("vec_id % 50 = 0"), 5)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, x in rows:
        if q % 50 == 0:
            scores = sorted((-sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(x, y)), i) for i, y in rows if i != q)
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert set(got) == {0, 50, 100, 150, 200, 250}
    assert topk.exact_top_k(df.limit(0), df, 5).count() == 0


def test_url_rules(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://EXAMPLE.org/en/12?x=/es/"), (4, "http://a.b.example.org/es/#t"),
            (5, "http://org"), (6, "x://notexample.org/en/1"), (6, "x://notexample.org/en/1"), (None, "http://x.com/de/")]
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    got = sorted(((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in rows_of(match_url_rules(pages, rules))))
    assert got == sorted([
        ("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "example.org", "/en/12", "example.org/en/1", "block"),
        ("4", "a.b.example.org", "/es/", "example.org/es/", "block"), ("5", "org", "", None, "allow"),
        ("6", "notexample.org", "/en/1", "org/", "allow"), ("6", "notexample.org", "/en/1", "org/", "allow"),
        ("None", "x.com", "/de/", "com/de/", "block"),
    ])
    assert match_url_rules(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in rows_of(match_url_rules(pages, rules.limit(0)))} == {"allow"}


def test_main_text_of_odd_pages():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use</div>"
        "<article><h1>A &amp; B</h1><p><b>One\n  two<br>three<p>Four<div class=share>Share</div><ul><li>x<li>y</ul>"
        "<section id=comments><p>First!</p></section></article><aside>More</aside><form><input>Go</form><footer>&copy;</footer>"
    )
    assert main_text(page) == "A & B\n\nOne two three\n\nFour\n\nx\n\ny"
    assert main_text(None) == main_text("") == main_text("<article") == ""
    assert main_text("<article><p>cut &am") == "cut &am"
    assert main_text("<p>a < b</p>text<script>x = '<p>'</script>") == "a < b\n\ntext"


def test_style_tree_removes_what_a_host_repeats(spark):
    def page(i):
        return f"<body><div class=box><p>Join our club today</p></div><div class=body><p>Story {i} about {i * 7}</p></div></body>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(20)]
    rows += [(90, "http://other.example/1", page(1)), (91, None, page(2)), (92, "http://h.example/x", None), (93, "http://h.example/0", page(0))]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path int")
    assert low_branches(style_tree(pages)).count() == 1
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in rows_of(extract_main_text(pages))}
    assert got[3] == ("Story 3 about 21", 16) and got[92] == ("", 0) and len(got) == len(rows)
    assert got[90][0] == "Join our club today\n\nStory 1 about 7" == got[91][0].replace("2", "1").replace("14", "7")
    assert extract_main_text(pages.limit(0)).count() == 0


def test_texts_that_a_host_repeats_in_its_articles(spark):
    def page(i, host):
        return f"<body><article><h1>Title {i} {host}</h1><p>Story {i} of {host}</p><p>All rights kept</p><ul><li>Join us</li></ul></article></body>"

    rows = [(i, f"http://{h}/{i}", page(i, h)) for h, n in (("big.example", 20), ("small.example", 3), ("two.example", 2)) for i in range(n)]
    rows += [(50 + i, f"http://copies.example/{i}", page(7, "copies")) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["url"]: r["text"] for r in rows_of(extract_main_text(pages))}
    for i, url, _ in rows:
        host = url.split("/")[2]
        if host in ("big.example", "small.example"):
            assert got[url] == f"Title {i} {host}\n\nStory {i} of {host}"
        elif host == "copies.example":
            assert got[url] == "Title 7 copies\n\nStory 7 of copies\n\nAll rights kept\n\nJoin us"
        else:  # two pages say nothing
            assert got[url].endswith("All rights kept\n\nJoin us")


@pytest.mark.parametrize(
    "html,want",
    [
        ("<div class='layout with-sidebar'><article><p>Text</p></article></div>", "Text"),
        ("<main class='content no-sidebar'><p>Text</p></main>", "Text"),
        ("<main><div class='no-sidebar'><article class='post comments-open'><p>Text</p></article></div></main>", "Text"),
        ("<article id='search-results'><p>Text</p></article>", "Text"),
        ("<form><div><article><p>Text</p></article></div></form>", "Text"),
        ("<form id=page><p>A whole page</p><input></form><div>foot</div>", "A whole page\n\nfoot"),
        ("<main><p>The text of the page</p></main><article><p>Teaser</p></article>", "The text of the page"),
        ("<article><p>The text of the page</p></article><div class=related><article><p>Teaser</p></article></div>", "The text of the page"),
        ("<article><p>Text</p><section class=comments><article><p>First!</p></article></section></article>", "Text"),
    ],
)
def test_no_article_is_furniture_by_its_name(html, want):
    assert main_text(f"<html><body>{html}</body></html>") == want


def test_pages_of_the_fixture(spark):
    from html import unescape
    from re import S, search, split, sub

    got = {r["page_id"]: r["text"] for r in rows_of(queries.op2_html_main_text(spark, SF))}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = sub("<br>", " ", search(r"<article>(.*?)(</article>|$)", r["html"], S)[1])
        blocks = [" ".join(unescape(sub("<[^>]*>", "", b)).split()) for b in split("</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n\n".join(filter(None, blocks))


# ---------------------------------------------------------------- pipeline


def test_quality_stage_judges_each_row_of_an_id(spark, documents):
    import corpus_pipeline as p

    good = documents.where("length(text) between 300 and 3000").limit(1).first()["text"]
    rows = [(1, good, "en", "a"), (1, "too short", "en", "a"), (None, good, None, None), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.quality_rules(spark, docs, SF)
    assert sorted(texts_of(got), key=str) == [(1, good), (None, good)]


def test_pipeline_stages(spark, documents, hostile):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    docs = documents
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == p.COLUMNS
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = after
    plan = p.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in plan.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    odd = hostile
    for _, stage in p.STAGES:
        odd = stage(spark, odd, SF)
    odd.count()
