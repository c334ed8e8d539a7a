"""Phrase collocations against a brute-force reading of the contract, and the counting trie on its own."""

import random
import re
from collections import Counter

import pytest

from vitrine.llm import collocations
from vitrine.llm.collocations import FOLD, HatTrie, Phrases, PhraseTable, WordNumbers, mine_collocations, sift

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute_force(rows, least, top, part_of):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for q, b in candidates.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    longer[q[i : i + m]] = max(longer[q[i : i + m]], b)
        kept = []
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= part_of * a:
                continue
            score, _, l, r = min(
                (2_000_000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p))
            )
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def check(df, least, top=2000, part_of=80):
    rows = [(r["text"], r["lang"]) for r in df.select("text", "lang").collect()]
    got = sorted(tuple(r) for r in mine_collocations(df, least, top, part_of=part_of).select(*COLUMNS).collect())
    want = brute_force(rows, least, top, part_of)
    assert got == want
    return got


@pytest.fixture(scope="module")
def phrases(spark):
    """A small language with set phrases, hot words, marks and odd spaces."""
    rnd = random.Random(5)
    words = ["the", "the", "the", "of", "sea", "Été", "x", "river bank", "new york city hall", "open", "a-b", " ", "İ"]
    rows = []
    for i in range(400):
        marks = [" ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "!", " ? "]
        text = "".join(rnd.choice(words) + rnd.choice(marks) for _ in range(rnd.randint(0, 60)))
        rows.append((text, rnd.choice(["en", "fr", None])))
    return spark.createDataFrame(rows, "text string, lang string")


def test_set_phrases(phrases):
    assert check(phrases, 5)
    assert check(phrases, 30, top=7)
    assert check(phrases, 12, part_of=40)


def test_spills_bursts_and_cut_pieces_change_nothing(phrases, monkeypatch):
    for name, value in (("HELD", 60), ("BURST", 3), ("SLICE", 90), ("GATHERED", 50), ("NUMBERED", 20), ("GROUP", 2000), ("RANKED", 9)):
        monkeypatch.setattr(collocations, name, value)
    assert check(phrases.repartition(3), 5)


def test_documents(sf_documents):
    assert check(sf_documents, 10)


def test_odd_documents(odd_documents, no_documents):
    assert check(odd_documents.unionAll(odd_documents), 2, part_of=101)
    assert mine_collocations(no_documents).count() == 0


def test_one_long_piece(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 200)
    rnd = random.Random(8)
    text = " ".join(rnd.choice("abcde") * rnd.randint(1, 3) for _ in range(3000))
    check(spark.createDataFrame([(text, "en"), ("q" * 1000, "en")], "text string, lang string"), 4)


def test_trie_counts_like_a_table(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 4)
    rnd, want, trie = random.Random(2), Counter(), HatTrie()
    bits = collocations.WORD_BITS
    for _ in range(4000):
        phrase = [rnd.randint(1, 6) for _ in range(rnd.randint(2, 4))]
        rest = sum(w << i * bits for i, w in enumerate(phrase[1:]))
        n = rnd.randint(1, 3)
        trie.add(phrase[0], [rest], [n])
        want[phrase[0], rest] += n
    assert trie.entries == len(want)
    large = trie.largest(len(want) // 2)
    assert sum(trie.size[f] for f in large) >= len(want) // 2
    got = {(f, rest): n for f in list(trie.root) for rest, n in trie.take(f)}
    assert got == dict(want) and trie.entries == 0


def test_no_frequent_phrase_is_sifted_out(phrases, spark):
    texts = phrases.selectExpr("coalesce(lang, 'und') lang", "text")
    share, tables = spark.sparkContext.broadcast, []
    for level in (1, 2, 3):
        tables.append(share(sift(texts, level, tables, 8, 3)))
    reader = Phrases([PhraseTable(t.value) for t in tables])
    found = {1: 0, 2: 0, 3: 0, 4: 0}
    for r in texts.collect():
        for n, _, at, _ in reader.read(r["lang"], (r["text"] or "").encode().translate(FOLD), 0):
            found[n] += len(at)
    counts = Counter()
    for r in texts.collect():
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), r["text"])):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts.update((r["lang"], *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    for k in range(1, 5):
        frequent = sum(n for p, n in counts.items() if len(p) == k + 1 and n >= 8)
        assert frequent <= found[k] <= frequent * 1.01


def test_folding_keeps_other_characters():
    text = "A,É z\tİ \x00 \x00\n"
    assert WordNumbers("en").read(text.encode().translate(FOLD)).tolist() == [1, 0, 2, 3, 4, 5, 5, 0]
