"""License scans: segments of a text against licence templates, in DataFrame expressions only.

A segment is the whole text, a paragraph (lines between blank lines) or a line. It is
normalised (lower case, runs of other characters than letters and digits are one space),
and its set of word bigrams is compared to each template's by the Dice coefficient
2 |A n B| / (|A| + |B|). With s and t the set sizes, Dice is at most 2 min(s, t) / (s + t),
so only templates with  threshold/(2-threshold) <= s/t <= (2-threshold)/threshold  are
compared. A segment that reaches the threshold shares most of a template's bigrams, hence
holds one of the template's `anchors`: words and bigrams chosen such that a segment without
them is bound to miss too many. Segments without an anchor are not compared.

A template that no segment has in full is also looked for in spans of the whole text's words, which
don't stop at lines or paragraphs: wording over several paragraphs, or with other words on its line.
Of the text's word bigrams those that the template has are hits. A span starts at a hit that has
enough hits in reach, and ends at the hit where 2 hits / (length + |B|) is highest (the last of
equal ones); it then counts by the same Dice of sets as a segment. Its segment is the normalised
words.

Everything happens in the row: no join, no shuffle. Templates are literals (a fixed,
small list).

Defined results: null, empty or one-word texts have no bigrams and no finds; each find is
given once per template with its best score (the first such segment); ties between
templates go to the name; repeated rows each give a row; very long texts count whole; no rows:
no rows; null ids keep their row; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.license_texts import MORE_TEMPLATES, TEMPLATES
from harrow.llm.words import let

THRESHOLD = 0.8


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(normal: Column) -> Column:
    """Distinct word bigrams of a normalised text."""
    return let(
        F.split(normal, " "),
        lambda w: F.when(
            F.size(w) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))
        ).otherwise(F.array().cast("array<string>")),
    )


def plain_bigrams(text: str) -> list[str]:
    """The same for a template, in Python."""
    words = "".join(c if c.isalpha() or c.isnumeric() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def anchors(templates: list[list[str]], threshold: float, long_word: int = 7) -> list[str]:
    """Words and bigrams such that a segment without any of them can't reach the threshold with any
    template: each template's bigrams without an anchor are fewer than the overlap that the threshold
    asks for. Long words first, as they are rare in prose; then bigrams, the longest first."""
    words: list[str] = []
    pairs: list[str] = []
    for grams in templates:
        # the smallest segment that can match has threshold/(2-threshold) t bigrams, all shared
        need = threshold / (2 - threshold) * len(grams)
        bare = lambda: [g for g in grams if g not in pairs and not set(g.split()) & set(words)]
        for w in sorted({w for g in grams for w in g.split() if len(w) >= long_word}, key=lambda w: (-len(w), w)):
            if len(bare()) >= need - 1e-9 and w not in words:
                words.append(w)
        for g in sorted(bare(), key=lambda g: (-len(g), g)):
            if len(bare()) >= need - 1e-9:
                pairs.append(g)
    return words + pairs


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES + MORE_TEMPLATES) -> DataFrame:
    """doc_id, license and score of the best find (null without one), finds: array of (template, license, score, segment)."""
    grams = [plain_bigrams(t[2]) for t in templates]
    words = anchors(grams, threshold)
    # the normaliser's idea of a word's ends, and its lower case, on the text as it is
    pattern = r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(w.replace(" ", r"[^\p{L}\p{N}]+") for w in words) + r")(?![\p{L}\p{N}])"
    reach = (2 - threshold) / threshold
    least, most = min(map(len, grams)) / reach, max(map(len, grams)) * reach
    literals = F.array(*[F.struct(F.lit(t[0]).alias("template"), F.lit(t[1]).alias("license"), F.array(*map(F.lit, g)).alias("grams")) for t, g in zip(templates, grams, strict=True)])
    text = F.coalesce(documents[text_col], F.lit(""))
    # A segment of more characters than words of any length could need is still compared by words: only sizes prune.
    segments = F.when(
        text.rlike(pattern),
        F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, "\n"))),
    ).otherwise(F.array().cast("array<string>"))
    anchored = F.filter(segments, lambda s: s.rlike(pattern))

    def compare(segment: Column) -> Column:
        def against(own: Column) -> Column:
            s = F.size(own)

            def dice(t: Column) -> Column:
                both = F.size(F.array_intersect(own, t["grams"]))
                return F.struct(
                    t["template"].alias("template"), t["license"].alias("license"), (F.lit(2.0) * both / (s + F.size(t["grams"]))).alias("score"), segment.alias("segment")
                )

            fits = lambda t: (s <= F.size(t["grams"]) * F.lit(reach)) & (F.size(t["grams"]) <= s * F.lit(reach))
            return F.filter(F.transform(F.filter(F.col("_templates"), fits), dice), lambda f: f["score"] >= F.lit(threshold))

        return let(bigrams(normalised(segment)), against)

    def spans(words: Column, pairs: Column, t: Column) -> Column:
        """The best span for a template, in an array; empty below the threshold."""
        size = F.size(t["grams"])
        need = F.greatest(F.ceil(size * F.lit(1 / reach) - F.lit(1e-9)).cast("int"), F.lit(1))
        longest = F.floor(size * F.lit(reach) + F.lit(1e-9)).cast("int")

        def best(at: Column) -> Column:
            n = F.size(at)
            length = lambda i, j: F.get(at, j) - F.get(at, i) + 1

            def from_start(i: Column) -> Column:
                ends = F.filter(F.sequence(i + need - 1, F.least(n, i + longest) - 1), lambda j: length(i, j) <= longest)
                end = F.array_max(F.transform(ends, lambda j: F.struct((2.0 * (j - i + 1) / (length(i, j) + size)).alias("hits"), j.alias("j"))))["j"]
                return let(F.struct(F.get(at, i).alias("start"), length(i, end).alias("length")), counted)

            def counted(span: Column) -> Column:
                own = F.array_distinct(F.slice(pairs, span["start"] + 1, span["length"]))
                return let(own, lambda o: F.struct((F.lit(2.0) * F.size(F.array_intersect(o, t["grams"])) / (F.size(o) + size)).alias("score"), (-span["start"]).alias("back"), span["length"].alias("length")))

            starts = F.filter(F.when(n >= need, F.sequence(F.lit(0), n - need)).otherwise(F.array().cast("array<int>")), lambda i: length(i, i + need - 1) <= longest)
            return let(
                F.array_max(F.transform(starts, from_start)),
                lambda b: F.when(
                    b["score"] >= F.lit(threshold),
                    F.array(F.struct(t["template"].alias("template"), t["license"].alias("license"), b["score"].alias("score"), F.array_join(F.slice(words, 1 - b["back"], b["length"] + 1), " ").alias("segment"))),
                ),
            )

        hits = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: F.array_contains(t["grams"], F.get(pairs, i)))
        enough = F.size(F.array_intersect(t["grams"], pairs)) >= need
        none = F.array().cast("array<struct<template:string,license:string,score:double,segment:string>>")
        return F.coalesce(F.when(enough, let(hits, best)), none)

    def in_text(words: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
        wanted = F.filter("_templates", lambda t: ~F.exists("_finds", lambda f: (f["template"] == t["template"]) & (f["score"] == 1)))
        return F.when(F.size(words) >= 2, let(pairs, lambda p: F.flatten(F.transform(wanted, lambda t: spans(words, p, t)))))

    counted = documents.select(documents[id_col].alias("doc_id"), anchored.alias("_segments"), F.when(F.size(segments) > 0, text).alias("_text")).withColumn("_templates", literals)
    found = counted.withColumn("_finds", F.flatten(F.transform("_segments", compare)))
    beyond = F.when(F.col("_text").isNotNull(), let(F.split(normalised(F.col("_text")), " "), in_text))
    found = found.withColumn("_finds", F.coalesce(F.concat("_finds", beyond), F.col("_finds")))
    best_of = lambda finds: F.array_sort(
        finds,
        lambda a, b: F.when(a["score"] > b["score"], F.lit(-1)).when(a["score"] < b["score"], F.lit(1)).when(a["template"] < b["template"], F.lit(-1)).when(a["template"] > b["template"], F.lit(1)).otherwise(F.lit(0)),
    )
    ordered = found.withColumn("_finds", F.when(F.size("_finds") > 0, best_of(F.col("_finds"))).otherwise(F.col("_finds")))
    names = F.transform("_finds", lambda f: f["template"])
    firsts = F.filter("_finds", lambda f, i: F.array_position(F.col("_names"), f["template"]) == i + 1)
    out = ordered.withColumn("_names", names).withColumn("finds", firsts)
    return out.select("doc_id", F.get("finds", F.lit(0))["license"].alias("license"), F.get("finds", F.lit(0))["score"].alias("score"), "finds")
