"""Word and shingle hashes against tuples of words."""

import numpy as np

from netlens.llm import shingles

TEXTS = ["One two  three\nfour five\tsix", "", None, " \n", "a" * 100 + " b", "É é ß STRASSE", "w " * 3000, "x" * 700]


def test_words_and_sets():
    for text in TEXTS:
        words = (text or "").lower().split()
        h = shingles.word_hashes(text)
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert shingles.word_hashes("É x")[0] == shingles.word_hashes("a é")[1]
    assert len(shingles.shingle_set("a b c")) == 1 and len(shingles.shingle_set("a b c d e f")) == 2
    assert not np.array_equal(shingles.shingle_set("a b c"), shingles.shingle_set("a c b"))


def test_pieces(monkeypatch):
    text = "some words of a long text, " * 50 + "y" * 300 + " end"
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "PIECE", 40)
    assert np.array_equal(shingles.word_hashes(text), whole)
