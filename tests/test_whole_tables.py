"""Registered queries on whole tables: rows that an earlier filter kept out, against brute force."""

import random
import re

from harrow.plans.queries import QUERIES


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_line_dedupe_reads_long_texts_and_null_lengths(spark, tmp_path):
    long = "\n".join(f"・ Line {i % 700} of\tmany" if i % 3 else f"LINE{i % 700}ofmany " for i in range(3000))
    texts = {1: long, 2: "a b\nAB\n\nc", 3: "x" * 5000, 4: "one\n one \ntwo", 5: "", 6: None}
    assert len(long) > 50_000
    put(spark, tmp_path, "documents", [(i, t, None if i == 4 or t is None else len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    expected = {6: (None, None)}
    for i, t in texts.items():
        if t is not None:
            lines = [s for s in (re.sub(r"^[\s・●■◆◇※]+", "", s).strip() for s in t.split("\n")) if s]
            expected[i] = (len(lines), len({re.sub(r"\s+", "", s).lower() for s in lines}))
    got = {r["doc_id"]: (r["n_lines"], r["n_distinct"]) for r in QUERIES["line_dedupe"](spark, str(tmp_path)).collect()}
    assert got == expected


def test_best_match_takes_every_part_as_key(spark, tmp_path):
    rng = random.Random(5)
    words = ["steel", "steam", "brass", "bra", "ring", "x1", "Tube"]
    names = {i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for i in range(900)}
    names |= {i: names[i - 500] for i in range(880, 890)} | {890: None, 891: "", 892: "zinc plate", 893: "zinc"}
    parts = [(i, n, rng.choice(["BRASS STEEL", "TUBE", "zinc plate, large"])) for i, n in names.items()]
    put(spark, tmp_path, "part", parts, "p_partkey long, p_name string, p_type string")
    norm = lambda s: re.sub("[^a-z0-9]+", "", s.lower())
    keys = [(i, norm(n)) for i, n in names.items() if n]
    expected = {}
    for t in {norm(" ".join(filter(None, (kind, n)))) for _, n, kind in parts}:
        scores = []
        for i, k in keys:
            gap = abs(len(t) - len(k))
            score = 10000 + len(k) if t == k else 2000 + len(k) - 2 * gap if len(k) >= 4 and k in t else 1000 + len(t) - 3 * gap if len(t) >= 4 and t in k else None
            if score is not None:
                scores.append((-score, i, k))
        if len(t) >= 3 and scores:
            score, i, k = min(scores)
            expected[t] = (i, k, -score)
    got = {r["value"]: (r["id"], r["label"], r["score"]) for r in QUERIES["best_match"](spark, str(tmp_path)).collect()}
    assert got == expected and sum(i >= 400 for i, _, _ in expected.values()) > 20


def test_longest_label_wants_the_whole_passage(spark, tmp_path):
    head = "The opening of forty characters, exactly, "
    labels = {1: head + "and one end", 2: head + "and one end, which goes on", 3: head + "and another end", 4: "A passage of its own that only one document has"}
    texts = {1: "x " + labels[1] + ".", 2: "y " + labels[2] + ".", 3: head + "and no end", 4: labels[4] + " " + labels[3], 5: "nothing", 6: None}
    put(spark, tmp_path, "benchmark", list(labels.items()), "item_id long, text string")
    put(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    expected = {}
    for i, t in texts.items():
        held = max(((len(v), -k) for k, v in labels.items() if t and v in t), default=None)
        expected[i] = (-held[1], labels[-held[1]]) if held else (None, None)
    got = {r["doc_id"]: (r["id"], r["label"]) for r in QUERIES["longest_label"](spark, str(tmp_path)).collect()}
    assert got == expected and expected[2][0] == 2 and expected[3] == (None, None)


def test_group_expand_takes_every_part(spark, tmp_path):
    parts = [(i, ["red ring", "Red bolt", "blue gear", "old plate"][i % 4], f"B{i % 3}", f"T{i % 2}", 1 + i % 50) for i in range(120)]
    put(spark, tmp_path, "part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    stems = {}
    for _, name, brand, kind, _ in parts:
        stems[brand, kind] = min(stems.get((brand, kind), "~"), name[:3].lower())
    expected = sorted((b, k, i) for (b, k), stem in stems.items() for i, name, _, kind, _ in parts if kind == k and name.lower().startswith(stem))
    got = sorted((r["group_id"], r["release_date"], r["member_id"]) for r in QUERIES["group_expand"](spark, str(tmp_path)).collect())
    assert got == expected


def test_grams_that_no_label_has_are_not_written(spark, monkeypatch):
    from harrow.operators import match
    from harrow.scratch import Scratch

    written, keep = {}, Scratch.keep

    def spy(self, df, name, **how):
        out = keep(self, df, name, **how)
        written[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", spy)
    texts = spark.createDataFrame([(1, "a long text " * 3 + "with needle in it, and more"), (2, "nothing of the kind, but long enough")], "doc_id long, t string")
    labels = spark.createDataFrame([(7, "needle")], "id long, label string")
    for most in (match.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(match, "BROADCAST_GRAMS", most)
        got = {r["doc_id"]: r["id"] for r in match.longest_label(texts, "t", labels, 4).select("doc_id", "id").collect()}
        assert got == {1: 7, 2: None} and written["holders"] == 3


def test_longest_label_has_no_shortest_label(spark, tmp_path):
    """Labels of any length count, the empty one too, as in the query's SQL."""
    import duckdb

    from harrow.plans.queries import ORACLES

    labels = {1: "a passage of more than thirty-two characters, whole", 2: "of", 3: "z", 4: "short one", 5: "", 6: "", 7: None, 8: "short one"}
    texts = {1: f"it has {labels[1]}.", 2: "a short one of these", 3: "of it", 4: "nothing", 5: "", 6: None, 7: "fizz"}
    put(spark, tmp_path, "benchmark", list(labels.items()), "item_id long, text string")
    put(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["id"], r["label"]) for r in QUERIES["longest_label"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, labels[1]), 2: (4, "short one"), 3: (2, "of"), 4: (5, ""), 5: (5, ""), 6: (None, None), 7: (3, "z")}
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet{'/*.parquet' if (tmp_path / f'{name}.parquet').is_dir() else ''}'")
    assert {d: (i, t) for d, i, t in con.execute(ORACLES["longest_label"]).fetchall()} == got


def test_labels_of_any_length_by_grams(spark):
    from harrow.operators import match

    texts = spark.createDataFrame([(1, "xaby" + "q" * 40), (2, "b"), (3, "cab"), (4, ""), (5, None)], "i long, t string")
    labels = spark.createDataFrame([(1, "b"), (2, "ab"), (3, "q" * 33), (4, "q" * 41), (5, "")], "id long, label string")
    got = {r["i"]: r["id"] for r in match.longest_label(texts, "t", labels).collect()}
    assert got == {1: 3, 2: 1, 3: 2, 4: None, 5: None}
