"""Product codes by integer Lloyd rounds against brute force: copies, nulls, odd vectors, ties, clashing names; joins of hot keys."""

import math
import random

import numpy as np

from harrow.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, row string, v string, position string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, y, "r", "v", "p") for i, e, y in rows], SCHEMA)


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in e], y) for i, e, y in rows if e and all(x is not None and math.isfinite(x) and abs(x * scale) < 2**28 for x in e)]
    dim = max({len(v) for _, v, _ in kept}, key=lambda d: (sum(len(v) == d for _, v, _ in kept), d))
    kept = [(i, v, y) for i, v, y in kept if len(v) == dim]
    w = dim // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[tuple(v[p * w : (p + 1) * w]) for _, v, _ in first] for p in range(parts)]

    def near(x, book):
        return min(((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book)))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                x = v[p * w : (p + 1) * w]
                own[near(x, books[p])[1]].append(x)
            books[p] = [tuple(sum(c) // len(o) for c in zip(*o, strict=True)) if o else books[p][j] for j, o in enumerate(own)]
    out = []
    for i, v, y in kept:
        found = [near(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, y, [j for _, j in found], sum(d for d, _ in found)))
    return out, books


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r[:2]) + tuple(r[2:]))


def test_codes_and_books_equal_brute_force(spark):
    rng = random.Random(3)
    vector = lambda: [rng.gauss(0, 0.4) for _ in range(8)]
    hot = vector()
    rows = [(i, vector(), rng.choice([0, 1, None])) for i in range(150)] + [(1000 + i, hot, 1) for i in range(120)]
    rows += [(3, vector(), 0), (3, rows[3][1], 0), (None, vector(), None), (2000, [0.0] * 8, 2), (2001, [-0.0001] * 8, 2), (2002, [2000.5] * 8, 2)]
    rows += [(5000, None, 1), (5001, [], 1), (5002, [None] + [0.1] * 7, 1), (5003, [float("nan")] * 8, 1), (5004, [float("inf")] * 8, 1), (5005, [1e300] * 8, 1), (5006, [0.1] * 4, 1)]
    done = codes.compress(frame(spark, rows), entries=16)
    expected, books = brute(rows, entries=16)
    assert order([(r["vec_id"], r["label"], list(r["entries"]), r["error"]) for r in done.codes.collect()]) == order(expected)
    assert done.book_text() == ",".join(str(x) for book in books for c in book for x in c)
    sums = {}
    for _, y, _, e in expected:
        sums[y] = sums.get(y, 0) + e
    told = codes.with_label_error(done.codes).collect()
    assert len(told) == len(expected) and all(r["label_error"] == sums[r["label"]] for r in told)
    back = {r["vec_id"]: r["vector"] for r in done.decode().collect()}
    assert np.abs(np.array(back[2000]) - 0.0).max() < 0.5


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(i, [i / 7, -i / 5, 0.5, 0.25], None) for i in range(5)]
    done = codes.compress(frame(spark, rows))
    assert order([(r["vec_id"], r["label"], list(r["entries"]), r["error"]) for r in done.codes.collect()]) == order(brute(rows)[0])
    assert codes.compress(frame(spark, rows).where("false")).codes.count() == 0
    assert codes.compress(frame(spark, [(1, [0.5] * 3, 1)])).codes.count() == 0  # 3 isn't a multiple of 4


def test_exact_beyond_double_precision():
    rows = np.array([[2**27, -(2**27)], [2**27 - 1, 5]], np.int64)
    book = np.array([[2**27 - 1, -(2**27)], [2**27, -(2**27) + 1]], np.int64)
    got = codes._nearest(rows, book)
    assert got[0].tolist() == [0, 1] and got[1].tolist() == [1, 1 + (2**27 + 4) ** 2]


def test_hot_and_other_keys_meet_their_facts(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i % 3 if i < 90 else i,) for i in range(120)], "k long")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert {(r["k"], r["n"]) for r in codes.join_hot(rows, facts, ["k"], F.col("n") > 5).collect()} == {(r["k"], r["n"]) for r in facts.collect()}
    assert codes.join_hot(rows, facts, ["k"], F.col("n") > 5).count() == 120
