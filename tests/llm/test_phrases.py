"""Collocations against brute force: repeats inside a piece, ties, languages, nulls, long texts in slices, blocks, clashing names."""

import random
import re
from collections import Counter

import pytest

from harrow.llm import phrases

SCHEMA = "doc_id long, text string, lang string, block string, id string, a string, word string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, "b", "i", "a", "w") for i, (t, lang) in enumerate(docs)], SCHEMA)


def brute(docs, least, longest=5, percent=100, most=2000):
    out = []
    for lang in {d[1] or "und" for d in docs}:
        f, n = Counter(), 0
        for text in (t or "" for t, x in docs if (x or "und") == lang):
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
                w = re.findall("[^ \t]+", piece)
                n += len(w)
                for k in range(1, longest + 1):
                    f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and percent * a <= 100 * b and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items())
            if not inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((" ".join(p), a, f[p[:k]], f[p[k:]], n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:most])]
    return sorted(out)


def mined(spark, docs, least, most=2000, **given):
    return sorted(tuple(r) for r in phrases.top_phrases(phrases.mine_phrases(frame(spark, docs), least=least, **given), most).collect())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    words = ["red", "Blue", "sea", "É", "été", "a", "b", "\x01x", "one two", "日本"]
    runs = ["the red sea is blue", "A b a b a b a", "once upon a time", "é É É"]
    text = lambda: " ".join(rng.choice(runs) if rng.random() < 0.4 else rng.choice(words) + rng.choice(["", "", ".", "!\t", "\n", "; "]) for _ in range(rng.randint(0, 60)))
    out = [(text(), rng.choice(["en", "en", "en", "fr", None])) for _ in range(120)]
    return out + [("copy of a passage that is here", "en")] * 40 + [(None, "en"), ("", "fr"), (" \t ", None), (". . !", "de"), ("the red sea " * 400, "en"), ("x", "und")]


@pytest.mark.parametrize("given", [{}, {"block_bytes": 300}, {"percent": 60}, {"longest": 3}, {"longest": 2}])
def test_mined_phrases_equal_brute_force(spark, docs, given):
    plain = {k: v for k, v in given.items() if k != "block_bytes"}
    assert mined(spark, docs, 6, **given) == brute(docs, 6, **plain)


def test_first_of_each_language(spark, docs):
    assert mined(spark, docs, 3, most=4) == brute(docs, 3, most=4)


def test_slices_end_between_words(spark, docs, monkeypatch):
    text = " ".join(t for t, _ in docs if t)
    whole = [w for part in phrases._tokens(text.encode()) for w in part]
    monkeypatch.setattr(phrases, "SLICE", 7)
    assert [w for part in phrases._tokens(text.encode()) for w in part] == whole and len(list(phrases._tokens(text.encode()))) > 50


def test_nothing_to_mine(spark, docs):
    assert mined(spark, docs, 10**6) == [] and mined(spark, [(None, None)], 1) == [] and phrases.mine_phrases(frame(spark, docs).where("false")).count() == 0
    with pytest.raises(ValueError):
        phrases._block_number(0, 1 << phrases.BLOCK_BITS)


def test_growing_tables_stay_off_the_driver_and_blocks_are_read_singly(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    seen, write = {}, DataFrameWriter.parquet

    def recorded(self, path, *args, **options):
        seen[path.rsplit("/", 1)[-1]] = self._df._jdf.queryExecution().executedPlan().toString(), spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
        return write(self, path, *args, **options)

    usual = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    docs = [("a b c d e f, a b c", "en"), ("a b c d x", "en"), ("b c d", None)] * 3
    mined = phrases.mine_phrases(frame(spark, docs), least=2, passes=1)
    plans = [p for p, _ in seen.values()] + [mined._jdf.queryExecution().executedPlan().toString()]
    joins = [line for p in plans for line in p.split("\n") if "Join" in line]
    assert sum("SortMergeJoin" in j for j in joins) >= 12
    assert not [j for j in joins if "Broadcast" in j and "[lang#" not in j]
    assert {n: size for n, (_, size) in seen.items() if n.startswith("named-")} == {f"named-{k}-0": "1" for k in range(1, 6)}
    assert seen["blocks-2"][1] == seen["grams-2"][1] == spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == usual
