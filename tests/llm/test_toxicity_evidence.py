"""Evidence of the toxicity scores: every neighbour that voted, for clean verdicts too."""

import random

from pyspark.sql import functions as F


def test_votes_follow_from_the_evidence(spark):
    from harrow.llm import toxicity

    rng = random.Random(2)
    insults, plain = ["grumbleworth", "snarkfool", "dolt"], [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(plain) for _ in range(40)) + (" " + rng.choice(insults) if i % 4 == 0 or i % 31 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    words, index = toxicity.learn(docs, labels, toxicity.fold(F.col("doc_id"), 5) != 0)
    at = {int(i): k for k, i in enumerate(index.ids)}
    out = toxicity.score_toxicity(docs, labels).collect()
    counts = set()
    for r in out:
        examples, cosines = index.nearest(words.vector(texts[r["doc_id"]]))
        assert [(e["id"], e["cosine"]) for e in r["evidence"]] == [(int(index.ids[e]), float(c)) for e, c in zip(examples, cosines)]
        shown = [at[e["id"]] for e in r["evidence"]]
        assert abs(index.calibrated(index.vote(toxicity.np.array(shown, int), toxicity.np.array([e["cosine"] for e in r["evidence"]]))) - r["score"]) < 1e-12
        counts.add(len(shown))
    assert max(counts) == toxicity.NEAREST


def test_every_labelled_text_is_an_example_and_no_term_goes(spark):
    from harrow.llm import toxicity

    rng = random.Random(5)
    texts = [" ".join(rng.choice([f"word{i}" for i in range(90)]) for _ in range(20)) for _ in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[4]), (None, "null id"), (500, "not labelled")], "doc_id long, text string")
    for clash in ("id", "y", "terms", "score", "held_out", "label"):
        docs = docs.withColumn(clash, F.lit(0))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(80)] + [(7, 1), (None, 1), (900, 0), (5, None)], "doc_id long, toxic int")
    words, index = toxicity.learn(docs, labels, F.col("doc_id") != 79)
    assert sorted(index.ids.tolist()) == list(range(79))
    assert set(words.place) == {t for i in range(79) for t in toxicity.terms_of(min(texts[3], texts[4]) if i == 3 else texts[i])}
    assert index.labels[index.ids.tolist().index(7)] == 1  # of several labels the greatest
    scored = toxicity.score_toxicity(docs, labels)
    assert scored.count() == 83 and {r["held_out"] for r in scored.where("doc_id is null").collect()} == {False}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("score = 0.5").count() == 83


def test_a_very_long_text_is_read_to_its_end(spark):
    from harrow.llm import toxicity

    rng = random.Random(9)
    plain = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(plain) for _ in range(30)) + (" dolt scum" if i % 3 == 0 else "") for i in range(150)]
    long = " ".join(rng.choice(plain) for _ in range(120_000))
    docs = spark.createDataFrame([*enumerate(texts), (1000, long), (1001, long + " dolt scum" * 40_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got[1000] < 0.5 < got[1001]
