"""Substring dedup against a brute-force version without arrays or digests, and clashing columns."""

import random
from collections import Counter

from tests.llm.test_llm import frame, rows_of

SIZE = 150


def windows(raw, table):
    """Places of the windows of a text's bytes, by the definition."""
    last = len(raw) - SIZE
    if last < 0:
        return []
    rolling = [sum(table[raw[i - j]] << j for j in range(min(i, 15) + 1)) % (1 << 32) for i in range(len(raw))]
    at = lambda s: (rolling[s + 15], s)
    return sorted({0, last} | {min((at(s) for s in range(a, a + 64)))[1] for a in range(last + 1 - 63)})


def brute(rows):
    """rows (id, text) -> (text, removed) of each row, in order."""
    from harrow.llm.substrings import gear_table

    table = [int(g) for g in gear_table()]
    spans = [windows((t or "").encode(), table) for _, t in rows]
    held = {}
    for (i, t), places in zip(rows, spans, strict=True):
        for a in places:
            if i is not None:
                held.setdefault((t or "").encode()[a : a + SIZE], set()).add(i)
    out = []
    for (i, t), places in zip(rows, spans, strict=True):
        raw, marks, keepers = (t or "").encode(), [], {}
        for a in places:
            first = min(held.get(raw[a : a + SIZE], {i}), default=None) if i is not None else None
            if first is not None and first < i:
                if marks and a <= marks[-1][1]:
                    marks[-1][1] = a + SIZE
                else:
                    marks.append([a, a + SIZE])
                    keepers[a] = Counter()
                keepers[marks[-1][0]][first] += 1
        text, removed, last = b"", [], 0
        for start, end in marks:
            a, b = start, end
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            text, last = text + raw[last:a], b
            names = keepers[start]
            removed.append((len(raw[:a].decode()), len(raw[a:b].decode()), min(names, key=lambda k: (-names[k], k))))
        out.append(((text + raw[last:]).decode() if removed else t, removed))
    return out


def test_against_brute_force(spark):
    from harrow.llm.substrings import dedup_substrings

    rng = random.Random(21)
    words = lambda n: " ".join("".join(rng.choice("abcdeéλ") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    passages = [words(n) for n in (12, 30, 45, 60, 90)]
    texts = [" ".join(rng.choice([words(rng.randrange(1, 30)), rng.choice(passages)]) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    texts += [None, "", "ab " * 300, "ab " * 200, texts[5], texts[7] + texts[9]]
    ids = [*range(len(texts)), 3, None, None]
    texts += [texts[3], texts[4], texts[4]]
    rows = [(i, *r[1:]) for i, r in zip(ids, rows_of(texts), strict=True)]
    docs = frame(spark, rows)
    for clash in ("_seen_id", "seen", "row", "digest", "first"):
        docs = docs.withColumn(clash, docs["n"])
    out = dedup_substrings(docs)
    assert out.columns == [c for c in docs.columns if c != "removed"] + ["removed"]
    got = sorted((str((r["doc_id"], r["text"], [tuple(s) for s in r["removed"]])) for r in out.collect()))
    assert got == sorted(str((i, *b)) for i, b in zip(ids, brute(list(zip(ids, texts, strict=True))), strict=True))
    assert sum(len(b[1]) for b in brute(list(zip(ids, texts, strict=True)))) > 20


def test_a_very_long_text(spark):
    from harrow.llm.substrings import dedup_substrings

    rng = random.Random(5)
    long = " ".join(f"{rng.randrange(10**7)}" for _ in range(150_000))
    rows = [(1, "kept: " + long[500_000:500_900]), (2, long)]
    out = {r["doc_id"]: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["removed"] == [] and len(out[2]["removed"]) == 1
    assert len(long) - len(out[2]["text"]) >= 900 - 126
