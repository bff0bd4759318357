"""Vectors are made without a text for each word's beginning, and equal those of the terms counted one by one."""

import numpy as np

from harrow.llm import toxicity


def test_vectors_equal_those_of_counted_terms():
    texts = ["One onerous onerous ONE word words wordy", "", None, "abcd abcde abcdef abcdz xyz", "unknown", "wordless wordless one"]
    terms = sorted({t for x in texts[:4] for t in toxicity.terms_of(x)})
    counts = np.arange(1.0, len(terms) + 1)
    words = toxicity.Vocabulary(terms, counts % 3, counts, 9, 40)
    assert words.begins == {t[1:]: i for i, t in enumerate(terms) if t.startswith("^")}
    for text in texts:
        known = sorted((words.place[t], n) for t, n in toxicity.terms_of(text).items() if t in words.place)
        at, weights = words.vector(text)
        w = np.array([(1 + np.log(n)) * words.weight[i] for i, n in known])
        live = w > 0
        assert at.tolist() == [i for (i, _), on in zip(known, live, strict=True) if on]
        assert np.allclose(weights, w[live] / np.sqrt((w**2).sum())) if len(at) else not len(weights)


def test_postings_are_kept_as_they_are_counted_and_beginnings_count_together():
    terms = sorted(["^abcd", "abcd", "abcde", "zz"])
    words = toxicity.Vocabulary(terms, np.array([3.0, 1, 2, 1]), np.array([1.0, 2, 1, 4]), 5, 6)
    at, weight = words.vector("abcdx abcdy ABCDE abcd q abcd zz")
    tf = np.array([3, 2, 1, 1])  # ^abcd: three words of more than four letters
    raw = (1 + np.log(tf)) * words.weight
    assert at.tolist() == [0, 1, 2, 3] and np.allclose(weight, raw / np.sqrt(raw @ raw), atol=1e-15)
    assert not len(words.vector("q r")[0]) and not len(words.vector(None)[0])
    index = toxicity.Index(4, np.array([7, 9]), np.array([1.0, 0.0]), [(at, weight), (at[:1], np.ones(1))], 0.5)
    assert index.example.dtype == np.int64  # not turned into it for each text
    assert index.nearest((at, weight))[1].round(9).tolist() == [1.0, round(float(weight[0]), 9)]
