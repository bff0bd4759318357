"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Each rule is a ratio of counted features; a document is rejected when the ratio exceeds
the rule's cutoff for the document's stratum. Cutoffs come from labelled documents that
are good: going from the most lenient cutoff of a grid to stricter ones, a cutoff counts
as safe while the exact (Clopper-Pearson) upper bound of its false-rejection rate stays
within the rule's share of the risk; the walk ends at the first that doesn't (fixed
sequence, so a walk needs no correction of its own). The level is divided by the number
of walks, rules x strata (Bonferroni). Among the safe cutoffs the one with the largest
difference of rejected bad to rejected good documents is used, the most lenient of equal
ones; a walk without a safe, useful cutoff rejects nothing. Then, with probability
1 - delta, no stratum loses more than `risk` of its good documents.

Bound as a test: upper(k, n) <= a  exactly when  P(Binomial(n, a) <= k) <= level; the sum
is taken in logarithms by an `aggregate` over 1..min(k, a n).

Defined results: null text has no words and fails the base; documents without labels are
never used to fit, and null ids have none; several labels of a document: good only if all are; a
null stratum or one outside `strata` counts as "other". No labels: no rule rejects. Repeated
rows each give a row; no rows: no rows; very long texts count whole; extra columns are ignored
whatever their names (kept_documents returns them); ties between cutoffs go to the lenient.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.words import SPACE_CLASS, let, words
from harrow.scratch import Scratch

#: Counts as n_repeat_words packs a window's hash and its place in a long: places need so many bits.
_PLACE_BITS = 24


@dataclass(frozen=True)
class Rules:
    """ratios: name -> (numerator, denominator) of feature columns; grid: cutoffs, lenient first."""

    ratios: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "symbols": ("n_symbols", "word_chars"),
            "dup_lines": ("n_dup_lines", "n_words"),
            "repeats": ("n_repeat_words", "n_words"),
            "shouting": ("n_upper", "word_chars"),
            "marks": ("n_marks", "n_words"),
        }
    )
    grid: tuple[float, ...] = (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)
    strata: tuple[str, ...] = ("en", "de", "fr", "es", "other")
    risk: float = 0.02
    delta: float = 0.05


def _count_removed(text: Column, keep_class: str) -> Column:
    """Number of code points left when all runs of keep_class are taken out."""
    return F.length(F.regexp_replace(text, keep_class, "")).cast("long")


def repeat_words(ws: Column) -> Column:
    """Words that lie in a 3-word window that the text has at least twice (the first one included).

    A window's hash (top bits) and place (low bits) go into one long; sorted, equal hashes are
    neighbours. Neighbours are compared word by word: if all equal hashes are equal windows, the
    flagged places are exact; if any differ, or the text is too long for the place bits, windows
    are sorted as strings instead.
    """
    low = (1 << _PLACE_BITS) - 1

    def covered(places: Column) -> Column:
        """Size of the union of [p, p+2] over sorted places."""
        start = F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda s, p: F.struct(p.cast("long").alias("at"), (s["n"] + F.least(F.lit(3).cast("long"), p - s["at"])).alias("n"))
        return F.aggregate(places, start, step, lambda s: s["n"])

    def with_equal_neighbours(keys: Column, same, place) -> Column:
        """Places of the sorted keys that equal the key before or after."""
        n = F.size(keys)
        hit = lambda k, i: ((i > 0) & same(k, F.get(keys, i - 1))) | ((i < n - 1) & same(k, F.get(keys, i + 1)))
        return F.array_sort(F.transform(F.filter(keys, hit), place))

    window = lambda w, i: [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    def by_string(w: Column) -> Column:
        keys = F.array_sort(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", *window(w, i)).alias("w"), i.cast("long").alias("i")))
        )
        return let(keys, lambda ks: covered(with_equal_neighbours(ks, lambda a, b: a["w"] == b["w"], lambda k: k["i"])))

    def by_hash(w: Column) -> Column:
        packed = F.array_sort(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.xxhash64(*window(w, i)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
            )
        )
        same = lambda a, b: F.shiftright(a, _PLACE_BITS) == F.shiftright(b, _PLACE_BITS)
        place = lambda k: k.bitwiseAND(F.lit(low))
        at = lambda k: place(k).cast("int")
        differ = lambda a, b: ~((F.get(w, at(a)) == F.get(w, at(b))) & (F.get(w, at(a) + 1) == F.get(w, at(b) + 1)) & (F.get(w, at(a) + 2) == F.get(w, at(b) + 2)))

        def decide(ks: Column) -> Column:
            n = F.size(ks)
            clash = F.exists(F.sequence(F.lit(1), n - 1), lambda i: same(F.get(ks, i), F.get(ks, i - 1)) & differ(F.get(ks, i), F.get(ks, i - 1)))
            return F.when((n > 1) & clash, by_string(w)).otherwise(covered(with_equal_neighbours(ks, same, place)))

        return let(packed, decide)

    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).when(F.size(ws) > low, by_string(ws)).otherwise(by_hash(ws))


def features(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with the counted features as further columns; one pass, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return (
        documents.withColumn("_words", words(text))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", _count_removed(text, SPACE_CLASS))
        .withColumn("n_symbols", _count_removed(text, "[^#*$%&|<>]+"))
        .withColumn("n_upper", _count_removed(text, r"[^\p{Lu}]+"))
        .withColumn("n_marks", _count_removed(text, r"[^!?=_~^{}\[\]\\/@+]+"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeat_words(F.col("_words")))
        .drop("_words", "_lines")
    )


def base_failed(min_words: int = 50, most_repeats: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(most_repeats) * F.col("n_words"))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """log P(Binomial(n, rate) <= k), for k <= n rate; larger k give log(1) = 0, which no level allows."""
    import math

    odds = math.log(rate) - math.log1p(-rate)
    first = n * F.lit(math.log1p(-rate))
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i.cast("double")) + F.lit(odds)
        high, lower = F.greatest(term, s["total"]), F.least(term, s["total"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(lower - high))).alias("total"))

    total = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda s: s["total"])
    return F.when(k > n * F.lit(rate), F.lit(0.0)).otherwise(total)


def fit_cutoffs(labelled: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """labelled: stratum, good (boolean), and the features -> stratum, rule, cutoff, n_good, rejected_good, rejected_bad.

    The counts are one aggregate of (stratum) rows with a counter for each rule and cutoff; after it,
    everything is strata x rules x cutoffs rows, whatever the corpus.
    """
    import math

    counters, names = [], []
    for rule, (top, under) in rules.ratios.items():
        ratio = F.col(top) / F.greatest(F.col(under), F.lit(1))
        for j, cutoff in enumerate(rules.grid):
            for kind, is_kind in (("good", F.col("good")), ("bad", ~F.col("good"))):
                counters.append(F.count_if(is_kind & (ratio > F.lit(cutoff))).alias(f"{kind}_{rule}_{j}"))
            names.append((rule, j, cutoff))
    counted = labelled.groupBy("stratum").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"), *counters)
    walks = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"), F.lit(j).alias("j"), F.lit(cutoff).alias("cutoff"), F.col(f"good_{rule}_{j}").alias("rejected_good"), F.col(f"bad_{rule}_{j}").alias("rejected_bad")
            )
            for rule, j, cutoff in names
        ]
    )
    level = math.log(rules.delta / (len(rules.ratios) * len(rules.strata)))
    rate = rules.risk / len(rules.ratios)
    tested = (
        counted.select("stratum", "n_good", "n_bad", F.explode(walks).alias("w"))
        .select("stratum", "n_good", "n_bad", "w.*")
        .withColumn("safe", binomial_tail(F.col("rejected_good"), F.col("n_good"), rate) <= F.lit(level))
    )
    ends = tested.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("safe"), F.col("j"))).alias("end"))
    gain = F.col("rejected_bad") / F.greatest("n_bad", F.lit(1)) - F.col("rejected_good") / F.greatest("n_good", F.lit(1))
    useful = tested.join(ends, ["stratum", "rule"]).where("(end is null or j < end) and rejected_bad > 0").withColumn("gain", gain).where("gain > 0")
    best = useful.groupBy("stratum", "rule").agg(
        F.max_by(F.struct("cutoff", "n_good", "rejected_good", "rejected_bad"), F.struct(F.round("gain", 9), -F.col("j"))).alias("b")
    )
    return best.select("stratum", "rule", "b.*")


def stratum_of(col: Column, rules: Rules) -> Column:
    named = [s for s in rules.strata if s != "other"]
    return F.when(col.isin(*named), col).otherwise(F.lit("other"))


def _ratio_of(c: Column, rules: Rules) -> Column:
    out = F.lit(None).cast("double")
    for rule, (top, under) in rules.ratios.items():
        out = F.when(c["rule"] == rule, F.col(top) / F.greatest(F.col(under), F.lit(1))).otherwise(out)
    return out


def _ruled(documents: DataFrame, labels: DataFrame, rules: Rules, scratch: Scratch, id_col: str, text_col: str, stratum_col: str, *more: Column) -> DataFrame:
    """The features are worked out once, into a table; `more` are columns that go into it as well."""
    narrow = documents.select(documents[id_col].alias("doc_id"), stratum_of(documents[stratum_col], rules).alias("stratum"), documents[text_col].alias("text"), *more)
    counted = scratch.keep(features(narrow).drop("text").withColumn("base_failed", base_failed()), "features")
    good = labels.where("quality is not null").groupBy(F.col(id_col).alias("doc_id")).agg((F.min("quality") >= 1).alias("good"))
    fitted = fit_cutoffs(counted.where("not base_failed").join(good, "doc_id"), rules)
    # at most strata x rules rows: one literal array, by scalar subquery
    cutoffs = fitted.agg(F.collect_list(F.struct("stratum", "rule", "cutoff")).alias("all")).select("all").scalar()
    hit = F.filter(F.col("_cutoffs"), lambda c: (c["stratum"] == F.col("stratum")) & (_ratio_of(c, rules) > c["cutoff"]))
    ruled = counted.withColumn("_cutoffs", cutoffs).withColumn("failed_rules", F.transform(hit, lambda c: c["rule"])).drop("_cutoffs")
    return ruled.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def apply_rules(documents: DataFrame, labels: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, the features, base_failed, stratum, failed_rules (array of names), kept.

    labels: id and quality (1 good, 0 bad).
    """
    return _ruled(documents, labels, rules, Scratch(documents.sparkSession, "rules"), id_col, text_col, stratum_col)


def kept_documents(documents: DataFrame, labels: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of documents that no rule rejects, each row judged by itself, whatever its id: rows meet their verdict by 128 bits of hash of id, text and stratum."""

    def marks(df: DataFrame) -> list[Column]:
        parts = [p for c in (id_col, text_col, stratum_col) for p in (df[c].isNull(), df[c])]
        return [F.xxhash64(F.lit(k), *parts).alias(f"mark{k}") for k in (1, 2)]

    ruled = _ruled(documents, labels, rules, Scratch(documents.sparkSession, "rules"), id_col, text_col, stratum_col, *marks(documents))
    kept = ruled.where("kept").select("mark1", "mark2").distinct()
    return documents.select(F.struct("*").alias("row"), *marks(documents)).join(kept, ["mark1", "mark2"], "left_semi").select("row.*")
