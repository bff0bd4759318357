"""Repeated passages just over the length that is always found, and anchors against brute force."""

import random

import numpy as np


def unique(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_every_passage_of_213_bytes_is_found(spark):
    from harrow.llm.substrings import dedup_substrings

    rng = random.Random(4)
    rows, passages = [], {}
    for k in range(300):
        passage = unique(rng, 50)
        while len(passage.encode()) < 213:
            passage += " " + unique(rng, 1)
        rows.append((k, f"{unique(rng, 30)} {passage} {unique(rng, 20)}"))
        rows.append((1000 + k, f"{unique(rng, 9)} {passage} {unique(rng, 40)}"))
        passages[1000 + k] = (k, passage)
    out = {r["doc_id"]: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k in passages if not out[k]["removed"]] == []
    for k, text in rows:
        if k < 1000:
            assert out[k]["text"] == text
            continue
        first, passage = passages[k]
        at = text.index(passage)
        for s in out[k]["removed"]:
            gone = text[s["start"] : s["start"] + s["length"]]
            assert s["kept_in"] == first and gone in out[first]["text"] and len(gone.encode()) >= 148  # a cut letter at either end stays
            assert s["start"] - at < 64 and at + len(passage) - s["start"] - s["length"] < 64


def test_anchors_against_brute_force(monkeypatch):
    from harrow.llm import substrings as s

    rng = np.random.default_rng(3)
    for n in (149, 150, 151, 212, 213, 214, 900):
        data = rng.integers(97, 123 if n % 2 else 99, n).astype(np.uint8)
        places = s.gear_hashes(data)[15 : n - 150 + 16].tolist() if n >= 150 else []
        expected = {0, n - 150} if n >= 150 else set()
        for a in range(len(places) - 63):
            expected.add(min(range(a, a + 64), key=lambda i: (places[i], i)))
        assert s.window_starts(data, 150) == sorted(expected)
        with monkeypatch.context() as m:
            m.setattr(s, "BLOCK", 100)
            assert s.window_starts(data, 150) == sorted(expected)
