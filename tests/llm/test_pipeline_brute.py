"""The whole pipeline against a brute-force version, and on empty, clashing, repeated and very long rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_llm import brute_components, brute_features
from tests.llm.test_mixing_brute import brute as brute_mix
from tests.llm.test_substrings_brute import brute as brute_cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(31)
    words = [f"{a}{b}" for a in ("stein", "fluß", "grün", "tree", "moon", "café", "x") for b in ("", "a", "en", "ing", "ó", "er", "um", "ly")]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    passage = text(60)
    texts = [text(rng.randrange(20, 160)) for _ in range(50)]
    texts += [f"{text(40)} {passage} {text(30)}" for _ in range(6)]
    texts += [" ".join([*texts[k].split()[:-1], "end"]) for k in (3, 4, 5)] + [texts[7], texts[8]]
    texts += ["a b c " * 60, None, "", text(20_000)]
    return [(i, t, ["en", "de", None][i % 3], ["big", "big", "big", "small", None][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]


def test_run_against_brute_force(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from harrow.llm.mixing import Mix

    rows = corpus()
    rows += [(None, rows[1][1], "en", "small", 1), rows[2]]  # a row without an id, and a repeated one
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = []
    for r in rows:
        n_words, _, _, _, repeats = brute_features(r[1])
        if n_words >= 50 and 100 * repeats <= 50 * n_words:
            good.append(r)
    named = sorted({r for r in good if r[0] is not None}, key=lambda r: r[0])
    groups = brute_components([r[1] for r in named])
    heads = [r for i, r in enumerate(named) if groups[i][1] == i] + [r for r in good if r[0] is None]
    cut = [(r[0], text, r[3]) for r, (text, _) in zip(heads, brute_cut([(r[0], r[1]) for r in heads]), strict=True)]
    times = {}
    for i, s, *_ in brute_mix(cut, Mix()):
        times[i, s] = times.get((i, s), 0) + 1
    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = []
    for i, text, source in cut:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want += [(i, source, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(decoded.encode()).hexdigest())] * times.get((i, source or ""), 0)
    got = [(r["doc_id"], r["source"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in p.run(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len(heads) < len(named) and sum(len(t or "") for _, t, _ in cut) < sum(len(r[1] or "") for r in heads)


def test_stages_on_no_rows_and_clashing_columns(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    rows = corpus()[:30]
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    wide = docs
    for clash in ("id", "row", "kept", "good", "stratum", "least", "component_id", "seen", "removed", "digest", "h", "block", "times", "whole", "n_tokens", "ids", "decoded", "mark1", "n_words"):
        wide = wide.withColumn(clash, F.lit("x"))
    for name, stage in p.STAGES:
        plain, clashing, none = (stage(spark, d, str(tmp_path)) for d in (docs, wide, docs.limit(0)))
        assert none.count() == 0 and none.columns == plain.columns == clashing.columns, name
        assert sorted(map(str, plain.collect())) == sorted(map(str, clashing.collect())), name
