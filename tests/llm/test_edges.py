"""Nulls, empty tables, ties, repeated rows, very long texts and clashing columns, for the operators whose other tests lack them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_llm import brute_features, frame, prose, rows_of


def clashing(docs, names):
    for name in names:
        docs = docs.withColumn(name, F.lit(1))
    return docs


def test_quality_edges(spark):
    from harrow.llm import quality

    rng = random.Random(2)
    lines = ["\n".join(prose(rng, 12) for _ in range(5)) for _ in range(80)]
    for i in range(0, 80, 3):
        lines[i] = "\n".join(" ".join(w.upper() + "!!" for w in x.split()) for x in lines[i].split("\n"))
    long_good = "\n".join(prose(rng, 12) for _ in range(9000))
    long_bad = "\n".join(" ".join(w.upper() + "!!" for w in prose(rng, 12).split()) for _ in range(9000))
    texts = [*lines, long_good, long_bad, None, "", " \n "]
    docs = frame(spark, [*rows_of(texts), rows_of(texts)[3], (None, lines[1], None, None, None, None, 1, 0.5, "r", "i", "h")])
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(80)] + [(80, 1), (81, 0), (None, 1), (4, 0), (4, 1), (5, None)], "doc_id long, quality int")
    wide = clashing(docs, ["id", "y", "bins", "size", "held_out", "predicted"])
    got = quality.score_quality(wide, labels).collect()
    assert len(got) == len(texts) + 2
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[80]["predicted"] == 1 and by_id[81]["predicted"] == 0  # learnt from whole, and scored whole
    assert by_id[82]["score"] == by_id[83]["score"] == by_id[84]["score"] < 0.5 and by_id[None]["held_out"] is False
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_long_chains_are_cut_only_while_fitting():
    import numpy as np

    from harrow.llm import quality

    rng = np.random.default_rng(4)
    sizes = [3, 1000, 5, 401]
    doc = np.repeat(np.arange(4), sizes)
    bins = rng.integers(0, 3, (len(doc), quality.MEASURES)).astype(np.uint8)
    bins[np.isin(doc, [1, 3])] += 2
    field = quality.fit_field(bins, np.ones(len(doc)), doc, np.array([1, 0, 1, 0]), rounds=2, steps=20)
    good = field.marginals(quality.columns_of(bins, doc), doc)
    assert good[doc == 0].mean() > 0.5 > good[doc == 1].mean() and good[doc == 2].mean() > 0.5 > good[doc == 3].mean()


def test_rules_edges(spark):
    from harrow.llm import rules

    rng = random.Random(3)
    texts = [prose(rng, 80), None, "", "a b c a b c " * 20_000, prose(rng, 100_000, [f"w{i}" for i in range(70_000)])]
    docs = frame(spark, [*rows_of(texts), rows_of(texts)[0], (None, texts[0], None, None, None, None, 1, 0.5, "r", "i", "h")])
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (99, 1), (2, None)], "doc_id long, quality int")
    wide = clashing(docs, ["good", "stratum", "kept", "n_words", "base_failed", "row", "mark1", "_words"])
    got = {(r["doc_id"], r["n_words"]): r for r in rules.apply_rules(wide, labels).collect()}
    for i, t in enumerate(texts):
        f = brute_features(t)
        r = got[i, f[0]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == f
        assert r["base_failed"] == (f[0] < 50 or 100 * f[4] > 50 * f[0])
    kept = rules.kept_documents(wide, labels)
    assert kept.columns == wide.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "0", "4", "None"]
    assert rules.apply_rules(docs.limit(0), labels).count() == 0


def test_rows_of_an_id_are_judged_each_by_itself(spark):
    from harrow.llm import rules

    rng = random.Random(8)
    rows = [(1, prose(rng, 80), "en"), (1, "too short", "en"), (None, prose(rng, 70), "en"), (None, "short", None)]
    kept = rules.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert sorted(len(r["text"].split()) for r in kept.collect()) == [70, 80]


def test_bpe_edges(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from harrow.llm import bpe

    rng = random.Random(6)
    path = public.path("word_bpe_49k.json")
    long = prose(rng, 60_000) + " é " + "x" * 30_000
    docs = clashing(frame(spark, [*rows_of([long, None, "", "tie tie"]), rows_of(["", "", "", "tie tie"])[3], (None, "no id", None, None, None, None, 1, 0.5, "r", "i", "h")]), ["n_tokens", "decoded", "_text"])
    got = bpe.encode_decode(docs, path).collect()
    library = Tokenizer.from_file(path)
    assert len(got) == 6
    for r in got:
        text = {0: long, 1: "", 2: "", 3: "tie tie", None: "no id"}[r["doc_id"]]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_neighbours_of_nothing_and_of_repeated_rows(spark):
    from harrow.llm import ann

    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (4, None)]
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ["vector", "score", "rank", "query_id", "bits"])
    got = sorted(tuple(r) for r in ann.nearest(table, table, k=2).collect())
    assert got == [(1, 1, 2, 0.0), (1, 2, 3, 2**0.5), (2, 1, 1, 0.0), (2, 2, 1, 0.0), (3, 1, 1, 2**0.5), (3, 2, 1, 2**0.5)]
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def test_bpe_caches_keep_what_a_batch_uses_when_they_are_full(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from harrow.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    made, library = bpe.Bpe(path), Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 40)
    merged = []
    monkeypatch.setattr(made, "_encoded", lambda words, f=made._encoded: merged.extend(words) or f(words))
    texts = [f"the same-{i} Words again  {chr(97 + i % 26) * 3}{i} it's あい <|endoftext|> {'x' * 60}{i}" for i in range(60)]
    for at in range(0, 60, 4):
        batch = [*texts[at : at + 4], "", None, " "]
        for text, (ids, decoded) in zip(batch, made.encode_decode(batch), strict=True):
            right = library.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == right
            assert decoded == library.decode(right, skip_special_tokens=False)
    assert len(made.pieces) <= 80 and len(made.words) <= 80
    assert merged.count(b"words") == merged.count(b"again") == 1
