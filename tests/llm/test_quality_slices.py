"""Slices by bytes: rows whole, in order, bounded; scores don't depend on them."""

import random

import numpy as np
import pyarrow as pa


def test_slices_hold_all_rows_in_order(monkeypatch):
    from harrow.llm import quality

    monkeypatch.setattr(quality, "SLICE_BYTES", 100)
    texts = ["a" * 40, "é" * 40, None, "", "b" * 500, "c" * 60, "d" * 41, "e" * 59]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["i", "text"])
    parts = [p.column(0).to_pylist() for p in quality.slices(batch, 1)]
    assert [i for p in parts for i in p] == list(range(8)) and parts == [[0], [1, 2, 3], [4], [5], [6, 7]]
    assert list(quality.slices(batch.slice(0, 0), 1)) == []


def test_scores_are_the_same_in_any_slices():
    from harrow.llm import quality

    rng = random.Random(3)
    texts = ["\n".join("".join(rng.choice("ab #1.X ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, "", "x"]
    field = quality.Field(np.random.default_rng(1).normal(size=quality.WIDTH), np.array([[0.3, -0.2], [-0.1, 0.4]]))
    together = quality.score_texts(field, texts)
    assert np.allclose(together, np.concatenate([quality.score_texts(field, [t]) for t in texts]))
