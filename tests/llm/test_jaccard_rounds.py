"""The Jaccard join's rounds: every link comes through an R-tree, pieces and repeated rows lose none."""

import itertools
import random

import numpy as np
from tests.llm.test_llm import brute_components, frame, prose, rows_of


def test_every_link_is_a_candidate_of_a_tree(spark, sf, monkeypatch):
    from harrow.llm import jaccard

    seen = []
    kept = jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda pairs, *rest: (seen.append(pairs.count()), kept(pairs, *rest))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    ids = [r["doc_id"] for r in rows]
    assert got == {ids[i]: ids[c] for i, (_, c) in enumerate(brute_components([r["text"] for r in rows]))}
    near = len({(r["text"] or "") for r in rows}) - len(set(got.values()))
    assert sum(seen) >= near >= 0 and sum(seen) > 0


def test_components_that_only_meet_across_pieces(spark, monkeypatch):
    """Chains of texts, each linked with the next only: the forests of small pieces can't join them all."""
    from harrow.llm import jaccard

    rng = random.Random(12)
    texts = []
    for _ in range(4):
        words = prose(rng, 90, [f"w{i}" for i in range(4000)]).split()
        for step in range(24):
            texts.append(" ".join(words))
            words = words[2:] + [f"n{rng.randrange(10**6)}", f"n{rng.randrange(10**6)}"]
    rng.shuffle(texts)
    monkeypatch.setattr(jaccard, "PIECE", 3)
    monkeypatch.setattr(jaccard, "LEAF", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, rows_of(texts))).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_a_row_repeated_a_thousand_times(spark):
    from harrow.llm import jaccard

    rng = random.Random(3)
    base = prose(rng, 120, [f"w{i}" for i in range(3000)])
    near = " ".join([*base.split()[:-2], "other", "end"])
    rows = rows_of([base, near, prose(rng, 50)])
    out = jaccard.jaccard_components(frame(spark, rows + [rows[0]] * 1000 + [rows[1]] * 1000))
    got = out.groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1001), (1, 0, 1001), (2, 2, 1)]


def test_null_ids_clashing_columns_and_very_long_texts(spark):
    from harrow.llm import jaccard

    rng = random.Random(4)
    long = prose(rng, 100_000, [f"w{i}" for i in range(50_000)])
    docs = frame(spark, rows_of([long, long + " more", None, ""]) + [(None, long, None, None, None, "t", 1, 0.5, "r", "i", "h")])
    for clash in ("id", "least", "component", "a", "point"):
        docs = docs.withColumn(clash, docs["n"])
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == [(0, 0), (1, 0), (2, 2), (3, 3), (None, None)]


def test_counts_are_never_cut_off():
    from harrow.llm import jaccard

    same = np.zeros(70_000, np.uint64)  # all in one group
    assert jaccard.point_of(jaccard.counts(same)).max() == 70_000
    assert jaccard.coarse_points([jaccard.counts(same), jaccard.counts(same[:200])]).max(1).tolist() == [70_000, 200]


def test_the_forest_spans_and_is_strongest():
    from harrow.llm.jaccard import forest

    rng = np.random.default_rng(1)
    n = 12
    pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.3]
    p, q = np.array(pairs).T
    w = rng.random(len(pairs))
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    kruskal = 0.0
    for i in np.argsort(-w):
        a, b = find(p[i]), find(q[i])
        if a != b:
            root[a] = b
            kruskal += w[i]
    taken = forest(n, p, q, w)
    assert abs(w[taken].sum() - kruskal) < 1e-9 and len(set(taken.tolist())) == len(taken)
