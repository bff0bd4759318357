"""Rows without a doc_id go through every stage of the pipeline."""

import random

import pytest


def test_rows_without_an_id_pass_every_stage(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice([f"word{i}" for i in range(600)]) for _ in range(n))
    texts = [text(80) for _ in range(20)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    nameless = [text(80), text(70)]
    nameless += [nameless[0], text(9)]  # a repeat stays, nine words fail the base
    rows += [(None, t, "en", "b", len(t)) for t in nameless]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES[:4]:
        docs = p.Scratch(spark, "test").keep(stage(spark, docs, str(tmp_path)), name)
        found = [r["text"] for r in docs.where("doc_id is null").collect()]
        assert set(found) == set(nameless[:3]) and docs.columns == p.COLUMNS
        assert len(found) == 3 if name != "mix_sources" else len(found) >= 3
        assert {r["doc_id"] for r in docs.where("doc_id is not null").collect()} == set(range(20))
    assert p.bpe_encode(spark, docs, str(tmp_path)).where("doc_id is null").count() == len(found)
