"""Mixing against a brute-force version in plain Python, with ties, nulls, repeats and clashing names."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from tests.llm.test_llm import frame


def digest(*parts):
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def brute(rows, mix):
    """rows (id, text, source) -> takings (id, source, n_tokens, pass_no, block, block_order, position)."""
    docs = [(i, s or "", len(re.findall("[^\x20\x09-\x0d]+", t or "")), digest(mix.seed, i, t)) for i, t, s in rows]
    tokens, count = defaultdict(int), defaultdict(int)
    for _, s, n, _ in docs:
        tokens[s] += n
        count[s] += 1
    live = {s: n for s, n in tokens.items() if n}
    total = sum(live.values())
    if live:
        entropy = lambda tau: (lambda w: -sum(x / sum(w) * math.log(x / sum(w)) for x in w))([(n / total) ** tau for n in live.values()])
        target = entropy(1) + mix.entropy * (math.log(len(live)) - entropy(1))
        low, high = 0.0, 1.0
        for _ in range(mix.rounds):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(mid) >= target else (low, mid)
        tau, repeat = low, min(live.values()) / max(live.values())
        if repeat ** (tau - 1) > mix.max_passes:
            low, high = tau, 1.0
            for _ in range(mix.rounds):
                mid = (low + high) / 2
                low, high = (low, mid) if repeat ** (mid - 1) <= mix.max_passes else (mid, high)
            tau = high
        raw = {s: (n / total) ** tau for s, n in live.items()}
        z = sum(raw.values())
        budget = mix.budget_tokens if mix.budget_tokens is not None else max(n / raw[s] for s, n in live.items()) * z
    out = []
    for s in tokens:
        passes = min(mix.max_passes, round(budget / z * raw[s] / tokens[s], 9)) if tokens[s] else 1.0
        whole, share = math.floor(passes), round((passes - math.floor(passes)) * tokens[s])
        mine = []
        for i, source, n, h in docs:
            if source == s:
                block = digest(mix.seed, h) % math.ceil(count[s] / mix.block_rows)
                out += [(i, s, n, p, block, digest(mix.seed, s, p, block), digest(mix.seed, h, p)) for p in range(1, whole + 1)]
                mine.append((digest(mix.seed, s, whole + 1, block), block, digest(mix.seed, h, whole + 1), h, i, n))
        groups = defaultdict(list)
        for m in mine:
            groups[m[:4]].append(m)
        before = 0
        for key in sorted(groups):
            if before >= share:
                break
            out += [(i, s, n, whole + 1, b, o, p) for o, b, p, _, i, n in groups[key]]
            before += sum(m[5] for m in groups[key])
    return out


@pytest.mark.parametrize("change", [{}, {"entropy": 0.9, "max_passes": 3.0, "block_rows": 16}, {"budget_tokens": 2500, "block_rows": 8}, {"max_passes": 1.1, "block_rows": 1}])
def test_against_brute_force(spark, change):
    from harrow.llm import mixing

    rng = random.Random(8)
    mix = mixing.Mix(**change)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), "big" if rng.random() < 0.7 else rng.choice(["s1", "s2", None, ""])) for i in range(700)]
    rows += [rows[3]] * 40 + [(None, "no id", "s1"), (None, "no id", "s1"), (900, None, "s2"), (901, None, "empty"), (902, "", "empty"), (903, "x " * 100_000, "s2")]
    docs = frame(spark, [(i, t, "en", s, 0, "t", 1, 0.5, "r", "i", "h") for i, t, s in rows])
    for clash in ("h", "block", "times", "plan", "whole", "cut_order", "n_blocks", "row"):
        docs = docs.withColumn(clash, docs["n"])
    want = sorted(map(str, brute(rows, mix)))
    got = mixing.mix_sources(docs, mix)
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "source", "n_tokens", "pass_no", "block", "block_order", "position").collect()) == want
    whole = mixing.mixed_documents(docs, mix)
    assert whole.columns == docs.columns
    assert sorted(str(tuple(r)) for r in whole.select("doc_id", "text").collect()) == sorted(str((b[0], t)) for b, t in with_texts(rows, brute(rows, mix)))


def with_texts(rows, taken):
    texts = defaultdict(list)
    for i, t, s in rows:
        texts[i, s or ""].append(t)
    return [(b, texts[b[0], b[1]][0]) for b in taken]


def test_no_rows(spark):
    from harrow.llm import mixing

    assert mixing.mixed_documents(frame(spark, [])).count() == 0
