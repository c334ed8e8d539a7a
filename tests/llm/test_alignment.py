"""Tokenizer alignment against a brute-force reading of its definition."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vitrine.llm import alignment, queries
from vitrine.llm.alignment import align_tokenizers, csr_product, link_texts, overlap_links
from vitrine.llm.bpe import byte_alphabet

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text, libraries):
    """``(ids, byte ends)`` of both tokenizers, or None."""
    a, b = libraries
    if not text:
        return None
    alphabet, raw = byte_alphabet(), (" " + text).encode()
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = b.encode(text)
    x_raw = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
    y_raw = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y
    ]
    if b"".join(x_raw) != raw or b"".join(y_raw) != raw:
        return None
    return (x, np.cumsum([len(r) for r in x_raw]).tolist()), (y, np.cumsum([len(r) for r in y_raw]).tolist())


def brute_force(texts, libraries):
    documents, counts = [], Counter()
    for text in texts:
        found = tokens(text, libraries)
        if found is None:
            documents.append(None)
            continue
        (x, x_ends), (y, y_ends) = found
        groups, i, j = [], 0, 0
        for end in sorted(set(x_ends) & set(y_ends)):
            gx, gy = [], []
            while i < len(x) and x_ends[i] <= end:
                gx.append(x[i])
                i += 1
            while j < len(y) and y_ends[j] <= end:
                gy.append(y[j])
                j += 1
            groups.append((gx, gy))
        links = [(p, q) for gx, gy in groups for p in gx for q in gy]
        counts.update(set(links))
        documents.append((len(x), len(y), groups, links))
    top = defaultdict(int)
    for (p, _), n in counts.items():
        top[p] = max(top[p], n)
    rows = []
    for d in documents:
        if d is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        text = ";".join(",".join(map(str, gx)) + "|" + ",".join(map(str, gy)) for gx, gy in groups)
        best = sum(counts[link] == top[link[0]] for link in links)
        digest = hashlib.sha256(text.encode()).hexdigest()
        rows.append((n_a, n_b, len(groups), len(links), best, sum(counts[link] for link in links), digest))
    return rows


def check(df, libraries, **params):
    rows = df.select("doc_id", "text").collect()
    want = sorted((str(r["doc_id"]), *w) for r, w in zip(rows, brute_force([r["text"] for r in rows], libraries)))
    got = align_tokenizers(df, A, B, **params).collect()
    # runs over the same bytes overlap in one pair more than the ends they do not share
    assert all(r["n_overlaps"] == r["n_a"] + r["n_b"] - r["n_groups"] for r in got)
    assert sorted((str(r["doc_id"]), *(r[n] for n in NAMES)) for r in got) == want


def test_products_match_dense_matrices():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        x, y = rnd.integers(0, 3, (7, 5)), rnd.integers(0, 3, (5, 6))

        def csr(m):
            at = np.nonzero(m)
            return np.concatenate([[0], np.cumsum((m != 0).sum(1))]), at[1], m[at]

        rows, columns, values = csr_product(csr(x), csr(y), 6)
        out = np.zeros((7, 6), int)
        out[rows, columns] = values
        assert (out == x @ y).all()


def test_products_in_small_blocks(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 3)
    test_products_match_dense_matrices()


def test_overlap_links_hold_the_shared_bytes():
    rows, columns, shared = overlap_links(np.array([3, 2, 4]), np.array([1, 4, 2, 2]))
    assert list(zip(rows.tolist(), columns.tolist(), shared.tolist())) == [
        (0, 0, 1), (0, 1, 2), (1, 1, 2), (2, 2, 2), (2, 3, 2)
    ]


def test_one_text_in_full(libraries):
    text = "Unbelievable tokenizers, été 12345 日本"
    full = link_texts(text, A, B)
    (x, x_ends), (y, y_ends) = tokens(text, libraries)
    assert full["a"] == x and full["b"] == y
    span = lambda ends, i: (ends[i - 1] if i else 0, ends[i])
    want = [
        (i, j, shared)
        for i in range(len(x))
        for j in range(len(y))
        if (shared := min(x_ends[i], y_ends[j]) - max(span(x_ends, i)[0], span(y_ends, j)[0])) > 0
    ]
    assert full["overlaps"] == want
    assert set(full["links"]) == {
        (i, j) for i in range(len(x)) for j in range(len(y)) if full["a_group"][i] == full["b_group"][j]
    }


def test_documents(sf_documents, libraries):
    check(sf_documents, libraries)


def test_odd_documents(odd_documents, no_documents, libraries):
    check(odd_documents, libraries)
    assert align_tokenizers(no_documents, A, B).count() == 0


@pytest.mark.parametrize("head", [0, 200])
def test_pairs_beyond_the_head_are_joined(sf_documents, libraries, head):
    check(sf_documents.limit(60), libraries, head=head)


def test_small_memories(spark, sf_documents, libraries, monkeypatch):
    al = alignment.Aligner(A, B)
    texts = [r["text"] for r in sf_documents.limit(40).collect()] + ["a a a", "", "▁", "tail "]
    want = al.align([t or "" for t in texts])
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 20_000)
    small = alignment.Aligner(A, B)
    for i, t in enumerate(texts):
        sizes, digests, pointer, pairs, links = small.align([t or ""])
        assert (sizes[0] == want[0][i]).all() and digests[0] == want[1][i]
        span = slice(want[2][i], want[2][i + 1])
        assert (pairs == want[3][span]).all() and (links == want[4][span]).all()
