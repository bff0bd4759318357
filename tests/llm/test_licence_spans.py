"""Licence wording that no single line or paragraph holds."""

import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def found(spark):
    from harrow.llm import licenses
    from harrow.llm.license_texts import MORE_TEMPLATES, TEMPLATES

    wording = {t[0]: t[2] for t in TEMPLATES + MORE_TEMPLATES}
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["river", "of", "the", "stone", "under", "light", "and", "any"]) for _ in range(n))
    mit, gpl = wording["mit-text"], wording["gpl-3.0-header"]
    parts = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    assert parts.count("\n\n") == 2
    texts = {
        "mit": f"{prose(300)}\n\n{parts}\n\n{prose(2000)}",
        "gpl": f"{prose(300)}\n\n{gpl.replace('version. This', 'version.' + chr(10) * 2 + 'This')}\n\n{prose(300)}",
        "copyright": "Copyright 2024 Jane Doe. Released under the MIT License.",
        "code": "The code is licensed under CC BY 4.0.",
        "sharealike": "The code is licensed under CC BY-SA 4.0.",
        "twice": f"{prose(50)} licensed under {prose(40)} The code is licensed under CC BY 4.0. {prose(50)} CC BY {prose(9)}",
        "none": f"license {prose(100)} permission {prose(500)} warranty merchantability",
        "half": f"{prose(90)} {mit[: len(mit) // 2]} {prose(90)}",
    } | {k: f"{prose(200)}\n{wording[k].replace('. ', '.' + chr(10) * 2)}\n{prose(200)}" for k, _, _ in MORE_TEMPLATES}
    rows = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    return {r["doc_id"]: r for r in licenses.scan_licenses(rows).collect()}


@pytest.mark.parametrize("name, licence", [("mit", "MIT"), ("gpl", "GPL-3.0"), ("copyright", "MIT"), ("code", "CC-BY-4.0"), ("sharealike", "CC-BY-SA-4.0"), ("twice", "CC-BY-4.0"), ("none", None), ("half", None)])
def test_spans_cross_lines_and_paragraphs(found, name, licence):
    assert found[name]["license"] == licence and (licence is None or found[name]["score"] == 1.0)
    assert licence is None or found[name]["finds"]


def test_more_texts_are_found_in_paragraphs(found):
    from harrow.llm.license_texts import MORE_TEMPLATES

    assert [(k, found[k]["license"], found[k]["score"]) for k, _, _ in MORE_TEMPLATES] == [(k, licence, 1.0) for k, licence, _ in MORE_TEMPLATES]


def brute(text, templates, threshold=0.8):
    """Templates that any run of the text's words reaches the threshold with."""
    from harrow.llm.licenses import plain_bigrams

    words = "".join(c if c.isalpha() or c.isnumeric() else " " for c in text.lower()).split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    found = {}
    for name, _, wording in templates:
        grams = set(plain_bigrams(wording))
        longest, best = int(len(grams) * 1.5), 0.0
        for i in range(len(pairs)):
            if pairs[i] not in grams:
                continue
            own, both = set(), 0
            for p in pairs[i : i + 2 * longest]:
                if p not in own:
                    own.add(p)
                    both += p in grams
                best = max(best, 2 * both / (len(own) + len(grams)))
        if best >= threshold:
            found[name] = best
    return found


def test_notices_in_their_usual_layout_against_all_runs_of_words(spark):
    from harrow.llm import licenses
    from harrow.llm.license_texts import MORE_TEMPLATES, TEMPLATES

    rng = random.Random(11)
    every = TEMPLATES + MORE_TEMPLATES
    prose = lambda n: " ".join(rng.choice(["river", "of", "the", "stone", "software", "light", "and", "any", "copy", "is", "License"]) for _ in range(n))
    wrapped = lambda t, w: "\n".join(" * " + " ".join(t.split()[i : i + w]) for i in range(0, len(t.split()), w))
    worn = lambda t: " ".join(x for x in t.split() if rng.random() > 0.04)
    texts = []
    for _, _, wording in every:
        texts += [f"{prose(60)}\n\n/*\n{wrapped(wording, 9)}\n */\n{prose(60)}", f"{prose(20)} {worn(wording)} {prose(20)}", "_" + wording.replace(" ", "_") + "_"]
    texts += [prose(300), "", None, wrapped(TEMPLATES[4][2], 12) + "\n\n" + wrapped(TEMPLATES[1][2], 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("finds", F.lit(0)).withColumn("_segments", F.lit(0)).withColumn("_templates", F.lit(0))
    out = {r["doc_id"]: {f["template"]: f["score"] for f in r["finds"]} for r in licenses.scan_licenses(docs).collect()}
    missed = []
    for i, t in enumerate(texts):
        want = brute(t or "", every)
        assert set(out[i]) <= set(want) and all(out[i][k] <= want[k] + 1e-9 for k in out[i])
        missed += [(i, k, want[k]) for k in want if k not in out[i]]
        assert i >= 3 * len(every) or i % 3 == 1 or every[i // 3][0] in out[i]
    assert [m for m in missed if m[2] >= 0.83] == [] and len(missed) <= 2


def test_very_long_texts_null_ids_and_no_rows(spark):
    from harrow.llm import licenses

    long = "river stone " * 80_000 + "Released under the MIT License. " + "of the " * 60_000
    docs = spark.createDataFrame([(None, long), (1, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs).collect()} == {None: "MIT", 1: None}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
