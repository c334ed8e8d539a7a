"""Letter vectors of the language profiles."""

import numpy as np

from vitrine.llm.hyperlang import Profiles


def test_every_letter_has_a_vector_of_its_own():
    points = np.array([ord(c) for c in "abcéß中อ츭яλ"] + list(range(0x5000, 0x5400)))
    vectors = Profiles().letters(points).astype(np.int64)
    cosine = vectors @ vectors.T / vectors.shape[1]
    np.fill_diagonal(cosine, 0)
    assert set(np.unique(vectors)) == {-1, 1}
    assert np.abs(cosine).max() < 0.25
    assert (Profiles().letters(points[::-1]) == vectors[::-1]).all()


def test_ngrams_bind_their_letters_by_place():
    p = Profiles()
    a, b, c = (p.letters(np.array([ord(x)]))[0] for x in "abc")
    codes = p.codes("xabcx")
    want = np.roll(a, 2) * np.roll(b, 1) * c
    got = p.vectors(codes)
    assert sum((v == want).all() for v in got) == 1
    assert p.codes("中").tolist() != p.codes("อ").tolist()


def test_texts_bundle_their_ngrams():
    p = Profiles()
    text = "zwölf Boxkämpfer jagen Viktor"
    total = p.vectors(p.codes(text)).astype(float).sum(axis=0)
    assert np.allclose(p.bundle([text, None, "123"])[0], total / np.linalg.norm(total), atol=1e-5)
    assert not p.bundle([text, None, "123"])[1:].any()
