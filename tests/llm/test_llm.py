"""Operators of the training-data subpackage against brute force, on small fixtures with nulls, empties, ties and repeats."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, n long, score double, removed string, ids string, head string"
WORDS = ["the", "of", "Red", "blue!", "ocean", "stone", "x", "été", "naïve", "run", "fast", "hill", "green", "tree", "moon"]


def prose(rng, n, words=None):
    words = words or [w + s for w in WORDS for s in ("", "a", "en", "ing")]
    return " ".join(rng.choice(words) for _ in range(n))


def rows_of(texts, start=0):
    return [(start + i, t, ["en", "de", None][i % 3], ["a", "a", "b", None][i % 4], None if t is None else len(t), "t", 1, 0.5, "r", "i", "h") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = [prose(rng, rng.choice([3, 8, 40, 120, 400])) for _ in range(60)]
    long = prose(rng, 3000)
    near = [" ".join(w if rng.random() > 0.02 else "zz" for w in out[k].split()) for k in (5, 6, 7, 8) for _ in range(3)]
    return out + near + [None, "", "   \n\t", "one two", "One TWO", long, long, out[3], "a\x1cb c d e f", "line\nline\n\nline two\nline"]


# ---- BPE

def test_bpe_equals_the_library(texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from harrow.llm.bpe import Bpe

    path = public.path("word_bpe_49k.json")
    ours, theirs = Bpe(path), Tokenizer.from_file(path)
    odd = ["<|endoftext|> Hi<|startoftext|>x", "İstanbul ΣΑΣ ς ﬁ", "a" * 5000, "ab'" * 300, "ポケモンカード、テスト", "it's I'LL x'd \x85\xa0y", "😀👨‍👩‍👧 <|x|>"]
    rng = random.Random(1)
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1400), rng.randrange(0x3000, 0x9000)])) for _ in range(80)) for _ in range(50)]
    every = texts + odd
    for text, (ids, decoded) in zip(every, ours.encode_decode(every), strict=True):
        expected = theirs.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert decoded == theirs.decode(expected, skip_special_tokens=False) == ours.decode(expected)


def test_bpe_caches_are_bounded(monkeypatch, texts):
    public = pytest.importorskip("public_tokenizers")
    from harrow.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    small = bpe.Bpe(public.path("word_bpe_49k.json"))
    monkeypatch.undo()
    large = bpe.Bpe(public.path("word_bpe_49k.json"))
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    for k in range(0, len(texts), 5):
        assert small.encode_decode(texts[k : k + 5]) == large.encode_decode(texts[k : k + 5])


def test_bpe_query_shape(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    from harrow.llm import bpe

    out = bpe.encode_decode(frame(spark, rows_of(texts)), public.path("word_bpe_49k.json"))
    assert out.columns.count("ids") == 1 and dict(out.dtypes)["ids"] == "binary"
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts) and got[72]["n_tokens"] == 0 and got[72]["decoded"] == ""
    assert bpe.encode_decode(frame(spark, []), public.path("word_bpe_49k.json")).count() == 0


# ---- Jaccard join

def brute_components(texts):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_components(spark, texts):
    from harrow.llm.jaccard import jaccard_components

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, rows_of(texts))).collect()}
    assert got == dict(enumerate(brute_components(texts)))
    assert jaccard_components(frame(spark, [])).count() == 0


def test_jaccard_large_blocks(spark, monkeypatch):
    """A passage in many documents, groups of near copies, and blocks that are cut into pieces."""
    from harrow.llm import jaccard

    rng = random.Random(5)
    passage = prose(rng, 60)
    base = prose(rng, 150).split()
    texts = [passage + " " + prose(rng, rng.choice([20, 60])) for _ in range(60)]
    texts += [" ".join(w if rng.random() > 0.03 else f"q{rng.randrange(99)}" for w in base) for _ in range(60)]
    monkeypatch.setattr(jaccard, "PIECE", 16)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark, rows_of(texts))).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_rtree_finds_all_that_may_link():
    from harrow.llm.jaccard import GROUPS, RTree, coarse_points, counts

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in rng.integers(5, 300, 120)]
    sets += [s[: max(1, int(len(s) * 0.9))] for s in sets[:40]]
    points = coarse_points([counts(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    p, q, _ = RTree(sizes, points).pairs(np.arange(len(sets)))
    found = {tuple(sorted(x)) for x in zip(p.tolist(), q.tolist(), strict=True)}
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 75 * (sizes[a] + sizes[b] - both):
            assert (a, b) in found
    assert points.shape[1] == GROUPS and len(found) < len(sets) ** 2 / 8


def test_finer_points_fold_onto_coarser():
    from harrow.llm import jaccard
    from harrow.llm.jaccard import folded

    counts = lambda hashes: jaccard.point_of(jaccard.counts(hashes))
    many = np.arange(1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (folded(counts(many), 128) == folded(folded(counts(many), 512), 128)).all() and counts(many).sum() == 2999


# ---- substring dedup

def test_passages_are_cut_and_clean_texts_stay(spark):
    from harrow.llm.substrings import dedup_substrings

    rng = random.Random(11)
    unique = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    passage = unique(60)
    texts = [unique(80) for _ in range(20)]
    texts[4] = unique(30) + " " + passage + " " + unique(20)
    texts[9] = unique(7) + " " + passage
    texts[15] = passage + " " + unique(33)
    texts += [None, "", "word " * 200, texts[2]]
    out = {r["doc_id"]: r for r in dedup_substrings(frame(spark, rows_of(texts))).collect()}
    assert len(out) == len(texts)
    middle = " ".join(passage.split()[15:45])
    assert middle in out[4]["text"] and middle not in out[9]["text"] and middle not in out[15]["text"]
    assert all(s["kept_in"] == 4 for i in (9, 15) for s in out[i]["removed"])
    assert out[23]["text"] == "" and out[20]["text"] is None and out[21]["text"] == ""
    for i in set(range(len(texts))) - {9, 15, 23}:
        assert out[i]["text"] == texts[i] and out[i]["removed"] == []
    for i in (9, 15):  # spans tell what is gone
        rest, at = "", 0
        for s in out[i]["removed"]:
            rest, at = rest + texts[i][at : s["start"]], s["start"] + s["length"]
        assert rest + texts[i][at:] == out[i]["text"]
    assert dedup_substrings(frame(spark, [])).count() == 0


def test_windows_resist_shifts():
    from harrow.llm.substrings import window_starts

    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    windows = lambda d: {d[a : a + 150].tobytes() for a in window_starts(d, 150)}
    shifted = np.concatenate([rng.integers(97, 123, 37).astype(np.uint8), data])
    assert len(windows(data) & windows(shifted)) > 0.9 * len(windows(data))


# ---- quality rules

def brute_features(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] >= 2 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_rule_features(spark, texts):
    from harrow.llm import rules

    odd = texts + ["a b c a b c", "a a a a a", "x y z", "x y z x y", "# | <b> a", "l\nl\nl \nl", "p q r s p q r t p q r"]
    got = rules.features(frame(spark, rows_of(odd))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: brute_features(t) for i, t in enumerate(odd)}


def test_repeat_words_survive_hash_clashes(spark, texts, monkeypatch):
    from harrow.llm import rules

    monkeypatch.setattr(rules, "_PLACE_BITS", 60)  # leaves four bits of hash: neighbours clash, strings decide
    got = rules.features(frame(spark, rows_of(texts))).select("doc_id", "n_repeat_words").collect()
    assert dict(map(tuple, got)) == {i: brute_features(t)[4] for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    from harrow.llm.rules import binomial_tail

    cases = [(k, n, p) for n in (5, 40, 300) for k in (0, 1, 3) for p in (0.02, 0.1)]
    for p in (0.02, 0.1):
        rows = [(k, n) for k, n, q in cases if q == p and k <= n * p]
        got = spark.createDataFrame(rows, "k long, n long").select("k", "n", binomial_tail(F.col("k"), F.col("n"), p)).collect()
        for k, n, value in got:
            assert math.isclose(math.exp(value), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def test_cutoffs_reject_junk_within_the_risk(spark):
    from harrow.llm import rules

    rng = random.Random(3)
    good = [prose(rng, 80, [f"w{i}" for i in range(3000)]) for _ in range(1200)]
    junk = [" ".join(w + "###" for w in prose(rng, 60, [f"v{i}" for i in range(900)]).split()) for _ in range(100)]
    rows = rows_of(good + junk)
    rows = [(*r[:2], "en", *r[3:]) for r in rows]
    labels = spark.createDataFrame([(i, int(i < 1200)) for i in range(1300) if i % 7], "doc_id long, quality int")
    few = rules.Rules(ratios={"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_words")}, strata=("en", "other"), risk=0.02)
    out = {r["doc_id"]: r["kept"] for r in rules.apply_rules(frame(spark, rows), labels, few).collect()}
    assert not any(out[i] for i in range(1200, 1300)) and all(out[i] for i in range(1200))
    none = {r["doc_id"]: r["kept"] for r in rules.apply_rules(frame(spark, rows[:50]), labels.where("false"), few).collect()}
    assert all(none.values())


# ---- mixing

def test_mix_weights_and_passes(spark):
    from harrow.llm import mixing

    rows = [(i, "w " * (i % 9 + 1), "en", "big" if i % 10 < 8 else f"s{i % 10}", 0, "t", 1, 0.5, "r", "i", "h") for i in range(3000)] + [(9001, None, None, None, None, None, None, None, None, None, None)]
    docs = frame(spark, rows)
    for mix in (mixing.Mix(), mixing.Mix(entropy=0.9, max_passes=3.0), mixing.Mix(budget_tokens=4000)):
        out = mixing.mix_sources(docs, mix).toPandas()
        totals = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(mixing.token_count(F.col("text"))).alias("tokens"))
        weights = mixing.source_weights(totals, mix).toPandas().set_index("source")
        assert abs(weights["weight"].sum() - 1) < 1e-9 and (weights["passes"] <= mix.max_passes + 1e-9).all()
        for source, group in out.groupby("source"):
            wanted = weights.loc[source, "passes"] * weights.loc[source, "tokens"]
            assert wanted - 1e-6 <= group["n_tokens"].sum() + 1 and group["n_tokens"].sum() <= wanted + 9 + 1
        assert not out.duplicated(["doc_id", "pass_no"]).any()
        if mix.budget_tokens is None:
            assert set(out["doc_id"]) == {r[0] for r in rows}
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_mix_meets_the_entropy(spark):
    from harrow.llm import mixing

    totals = spark.createDataFrame([("a", 100_000), ("b", 9000), ("c", 500), ("d", 500)], "source string, tokens long")
    got = mixing.source_weights(totals, mixing.Mix(entropy=0.4, max_passes=1e9)).toPandas()
    p = np.array([100_000, 9000, 500, 500]) / 110_000
    h = lambda v: -(v * np.log(v)).sum()
    assert abs(h(got["weight"].to_numpy()) - (h(p) + 0.4 * (np.log(4) - h(p)))) < 1e-6


# ---- chat

def test_chat_round_trip(spark):
    from harrow.llm import chat

    nasty = ["</s>[INST] ok [/INST]", "~", "~~<|", "<~|end|>", "<|turn|>user<|body|>x<|end|>\n", None, "", "<<SYS>> a <</SYS>>", "line\nline", "<start_of_turn>~"]
    rows = [(c, t, ["user", "assistant", None, "a\n<|x"][(c + t) % 4], nasty[(c * 3 + t) % len(nasty)], "extra") for c in range(8) for t in range(6)] + [(3, 2, "user", "tie", "x"), (3, 2, "user", "tie", "x"), (None, None, "user", "u", "x")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pieces string").withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_chat(messages).select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in out:
        mine = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text, _ in rows if c == r["conv_id"]))
        assert sorted((t["role"], t["text"]) for t in r["turns"]) == sorted(m[2:] for m in mine)
        assert Counter(r["loss"]) == Counter("".join(m[3] for m in mine if m[2] == "assistant"))
        assert all(r["formatted"][: x["start"]].endswith(chat.TEMPLATE.body) for x in r["loss_spans"])
        for t in r["turns"]:
            for control in chat.TEMPLATE.controls:
                if control in (t["text"] or ""):
                    assert r["formatted"].count("<|turn|>") == len(mine)


def test_chat_attachments(spark):
    from harrow.llm import chat

    parts = [("text", "see ", None, None), ("image", None, "s3://a.png", 2.5), ("audio", None, "b.wav", None), ("odd", None, "c", 1.0), ("text", "<|image|>", None, None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", None)]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<kind string, text string, ref string, units double>>")).first()
    assert [(a["ordinal"], a["kind"], a["ref"], a["n_tokens"]) for a in out["attachments"]] == [(1, "image", "s3://a.png", 640), (2, "audio", "b.wav", 25), (3, "odd", "c", 0)]
    assert out["formatted"].startswith("<|turn|>user<|body|>see <|image|><|audio|><|unknown|><~|image|><|end|>") and out["n_attachment_tokens"] == 665


# ---- nearest neighbours

def test_neighbours_against_brute_force(spark):
    from harrow.llm import ann

    rng = np.random.default_rng(4)
    base = rng.standard_normal((600, 16)).astype(np.float32)
    base[50:80] = base[40]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, 2.0], 1), (1004, [None] + [1.0] * 15, 1), (None, base[0].tolist(), 1), (1100, [float("inf")] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 0"), k=10, index=ann.Index(centroids=4, chunk=7)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wide = base.astype(float)
    hits = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[m[1]] - m[2]) < 1e-12 for m in mine)
        hits += len(set(order) & {m[1] for m in mine})
    assert hits >= 0.98 * 300 and set(got) == set(range(0, 600, 20))
    assert [m[1] for m in sorted(got[40])][:3] == [50, 51, 52]
    assert ann.nearest(table.where("vec_id > 5000"), table, k=3).count() == 0
    assert ann.nearest(table.where("vec_id < 4"), table.where("vec_id = 0"), k=10).count() == 3


# ---- licences

def test_license_scan_against_brute_force(spark):
    from harrow.llm import licenses
    from harrow.llm.license_texts import TEMPLATES

    rng = random.Random(9)
    mit = dict((t[0], t[2]) for t in TEMPLATES)["mit-text"]
    worn = " ".join(w for w in mit.split() if rng.random() > 0.03)
    texts = [prose(rng, 90) + "\n" + TEMPLATES[0][2] + "\n" + prose(rng, 9), worn, "x\n\n" + mit.replace(". ", ".\n") + "\n\ny", prose(rng, 200), None, "", "license", "under the by nc of it", "Licensed under CC-BY NC 4.0"]
    grams = [set(licenses.plain_bigrams(t[2])) for t in TEMPLATES]

    def brute(text):
        text = text or ""
        found = {}
        for s in [text, *re.split("\n[ \t\r]*\n", text), *text.split("\n")]:
            own = set(licenses.plain_bigrams(s))
            for t, g in zip(TEMPLATES, grams, strict=True):
                d = 2 * len(own & g) / max(1, len(own) + len(g))
                if own and d >= 0.8:
                    found[t[0]] = max(found.get(t[0], 0), d)
        return found

    out = {r["doc_id"]: {f["template"]: f["score"] for f in r["finds"]} for r in licenses.scan_licenses(frame(spark, rows_of(texts))).collect()}
    assert {i: {k: round(v, 9) for k, v in f.items()} for i, f in out.items()} == {i: {k: round(v, 9) for k, v in brute(t).items()} for i, t in enumerate(texts)}
    assert out[0] and "mit-text" in out[1] and "mit-text" in out[2]


# ---- classifiers

def test_forward_backward_against_enumeration():
    from harrow.llm.quality import WIDTH, Field

    rng = np.random.default_rng(1)
    field = Field(rng.standard_normal(WIDTH), rng.standard_normal((2, 2)))
    columns, doc = rng.integers(0, WIDTH, (9, 5)), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    good, joint = field.marginals(columns, doc, pairs=True)
    total = np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        node = field.weights[columns[at]].sum(1)
        z, marginal, pair = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=len(at)):
            w = math.exp(sum(n for n, s in zip(node, states, strict=True) if s) + sum(field.step[a, b] for a, b in itertools.pairwise(states)))
            z += w
            marginal += w * np.array(states)
            for a, b in itertools.pairwise(states):
                pair[a, b] += w
        assert np.allclose(good[at], marginal / z)
        total += pair / z
    assert np.allclose(joint, total)


def test_line_bins_are_per_document():
    from harrow.llm.quality import MEASURES, line_bins

    texts = ["abc def\n\nGHI GHI GHI\nabc def", None, "", "   ", "x\0y ### !!\n" + "é " * 50]
    bins, size, doc = line_bins(texts)
    assert bins.shape[1] == MEASURES and doc.tolist() == [0, 0, 0, 4, 4]
    alone = [line_bins([t])[0] for t in texts]
    assert (np.concatenate(alone) == bins).all()
    assert bins[0, -1] == 0 and bins[2, -1] == 1  # the second "abc def" has one earlier equal line


def test_quality_on_held_out_rows(spark):
    from harrow.llm.quality import score_quality

    rng = random.Random(2)
    texts = ["\n".join(prose(rng, 12) for _ in range(6)) for _ in range(200)]
    for i in range(0, 200, 3):
        texts[i] = texts[i].split("\n")[0] + "\n" + "\n".join(" ".join(w.upper() + "!!" for w in x.split()) for x in texts[i].split("\n")[1:])
    labels = spark.createDataFrame([(i, int(i % 3 != 0), None) for i in range(200)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows_of([*texts, None, ""]))
    out = {r["doc_id"]: r for r in score_quality(docs, labels).collect()}
    held = [r for r in out.values() if r["held_out"] and r["doc_id"] < 200]
    assert len(held) > 30 and all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held)
    assert out[200]["score"] == out[201]["score"] < 0.5
    assert {r["score"] for r in score_quality(docs, labels.where("quality = 1")).collect()} == {0.5}


def test_block_max_search_is_exact(monkeypatch):
    from harrow.llm import toxicity

    rng = np.random.default_rng(8)
    vectors = []
    for _ in range(700):
        terms = np.unique(np.minimum(rng.geometric(0.06, rng.integers(1, 14)), 60)) - 1
        w = rng.random(len(terms)) + 0.1
        vectors.append((terms, w / np.linalg.norm(w)))
    ids = rng.permutation(5000)[:700]
    for common in (3, 50):  # few and many terms are common ones
        monkeypatch.setattr(toxicity, "COMMON", common)
        index = toxicity.Index(60, ids, rng.integers(0, 2, 700).astype(float), vectors, 0.1)
        assert 0 < len(index.block_max) < 60
        full = np.zeros((700, 60))
        for row, (t, w) in zip(full, vectors, strict=True):
            row[t] = w
        for q in range(0, 700, 9):
            cosines = np.round(full @ full[q], 12)
            best = [e for e in np.lexsort((ids, -cosines)) if cosines[e] > 0][:15]
            found, scores = index.nearest(vectors[q])
            assert np.allclose(scores, cosines[best]) and index.ids[found].tolist() == ids[best].tolist()
            found, _ = index.nearest(vectors[q], without=index.ids.tolist().index(ids[q]))
            assert ids[q] not in index.ids[found]


def test_toxicity_on_held_out_rows(spark):
    from harrow.llm.toxicity import score_toxicity

    rng = random.Random(6)
    insults = ["grumbleworth", "snarkfool", "dolt"]
    texts = [prose(rng, 40) for _ in range(300)]
    for i in range(0, 300, 4):
        w = texts[i].split()
        for _ in range(2):
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        texts[i] = " ".join(w)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows_of([*texts, None, ""]))
    out = {r["doc_id"]: r for r in score_toxicity(docs, labels).collect()}
    held = [r for r in out.values() if r["held_out"] and r["doc_id"] < 300]
    assert len(held) > 30 and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert all(e["label"] in (0, 1) for r in held for e in r["evidence"]) and out[300]["score"] < 0.5
    assert {r["score"] for r in score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.5}


# ---- pipeline

def test_pipeline_stages(spark, sf):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = {r["doc_id"]: r for r in docs.collect()}
    kept = p.quality_rules(spark, docs, sf)
    assert kept.columns == p.COLUMNS
    base = {i for i, r in table.items() if (f := brute_features(r["text"]))[0] >= 50 and 100 * f[4] <= 50 * f[0]}
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert set(ids) <= base and len(ids) >= 0.9 * len(base)
    heads = p.ngram_jaccard(spark, kept, sf)
    groups = brute_components([table[i]["text"] for i in ids])
    assert sorted(r["doc_id"] for r in heads.collect()) == sorted({ids[c] for _, c in groups})
    cut = p.substring_dedup(spark, heads, sf)
    assert cut.columns == p.COLUMNS and cut.count() == heads.count()
    mixed = p.mix_sources(spark, cut, sf)
    assert {r["doc_id"] for r in mixed.select("doc_id").collect()} == {r["doc_id"] for r in cut.select("doc_id").collect()}
    last = p.run(spark, sf)
    assert last.count() == mixed.count()


def test_pipeline_drops_repeated_rows(spark, sf):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    rng = random.Random(1)
    rows = rows_of([prose(rng, 60, [f"w{i}" for i in range(500)]) for _ in range(5)])
    assert p.ngram_jaccard(spark, frame(spark, [*rows, rows[2], rows[2]]), sf).count() == 5


def test_digests_of_the_chat_query(spark, sf):
    from harrow.llm.queries import op8_chat_format

    row = op8_chat_format(spark, sf).where("conv_id = -1").first()
    probe = "</s>[INST] ok [/INST]"
    assert row["n_turns"] == 2 and row["loss_sha256"] == hashlib.sha256(probe.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
