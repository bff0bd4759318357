"""Mixing sources to target weights: temperature mixing, in DataFrame expressions only.

A source with a share p of the tokens gets a weight in proportion to p ** tau. A lower
tau evens the sources out: the entropy of the weights rises, and the small sources have
to be repeated more often. tau is found by bisection, on the table of source totals:
the value that meets the target entropy, or the smallest one that keeps the number of
passes over any source within `max_passes`, whichever is larger.

The weights are realised within a token budget as block permutations. A source's
documents are dealt into blocks by hash; pass after pass, the blocks come in an order
hashed from the pass, and the documents of a block likewise. Whole passes are taken
while the source's share of the budget lasts; in the last pass whole blocks are taken in
order, and documents in order from the block in which the share ends.

Where the share ends is looked for from coarse to fine: totals by the first 12 bits of the
blocks' order, by the next 12 inside the range that holds the end, by block, and by document
inside the one block. Each step is one aggregate, and its running total meets at most 4096
ranges of a source (a few blocks, the documents of a block): no task holds a source. What a
document gets is then decided in its own row, by its source's line of the plan; documents
don't move, nor do their texts.

Tokens are words here: mixing comes before encoding. Hashes are the first 60 bits of MD5.

Defined results: null sources are a source of their own (empty name); null or empty text has
0 tokens and is taken once per whole pass; sources without tokens keep weight 0 and one pass;
rows alike in id and text are rows of their own, and stay or go together where the last pass
ends among them; null ids are ids; very long texts count whole, and the last pass may end
beyond the share by the one document in which it ends; extra columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.words import SPACE_CLASS
from harrow.scratch import Scratch


@dataclass(frozen=True)
class Mix:
    """entropy: target, as a share of the way from the entropy of the token shares to log(number of sources).
    max_passes: most passes over any source. budget_tokens: None takes the smallest budget in which every
    source has at least one whole pass. block_rows: expected documents in a block. rounds: halvings of tau."""

    entropy: float = 0.5
    max_passes: float = 1.5
    budget_tokens: int | None = None
    block_rows: int = 512
    rounds: int = 40
    seed: int = 17


def token_count(text: Column) -> Column:
    """Number of words, as a count of tokens."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE_CLASS}|{SPACE_CLASS}$", "")
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, SPACE_CLASS))).cast("long")


def _bracket(totals: DataFrame, mix: Mix) -> tuple[float, float]:
    """tau by bisection, then the budget over all tokens. Each round is one aggregate over the source totals."""
    live = totals.where("tokens > 0")
    base = live.agg(F.sum("tokens").alias("n"), F.count("*").alias("k"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if not base["k"]:
        return 1.0, 0.0
    share = F.col("tokens") / F.lit(float(base["n"]))
    h1 = live.agg(F.sum(-share * F.log(share)).alias("h")).first()["h"]
    import math

    target = h1 + mix.entropy * (math.log(base["k"]) - h1)

    def entropy_at(taus: list[float]) -> list[float]:
        # H = log Z - tau * sum(p^tau log p) / Z; the shares are scaled by the largest to stay in range
        top = float(base["most"]) / base["n"]
        terms = []
        for i, tau in enumerate(taus):
            power = F.exp(F.lit(tau) * F.log(share / top))
            terms += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(share / top)).alias(f"s{i}")]
        row = live.agg(*terms).first()
        return [math.log(row[f"z{i}"]) - tau * row[f"s{i}"] / row[f"z{i}"] for i, tau in enumerate(taus)]

    def passes_at(tau: float) -> float:
        # most over least passes: budget = the most passes with the largest source at one pass
        return (base["least"] / base["most"]) ** (tau - 1.0)

    low, high = 0.0, 1.0  # the entropy falls as tau rises
    step = 4  # several halvings to a job: all their points are evaluated in one aggregate
    for _ in range(0, mix.rounds, step):
        points = [low + (high - low) * i / 2**step for i in range(1, 2**step)]
        above = [p for p, h in zip(points, entropy_at(points), strict=True) if h >= target]
        at = max(above, default=low)
        low, high = at, min((p for p in points if p > at), default=high)
    tau = low
    if passes_at(tau) > mix.max_passes:
        low, high = tau, 1.0
        for _ in range(mix.rounds):
            mid = (low + high) / 2
            low, high = (low, mid) if passes_at(mid) <= mix.max_passes else (mid, high)
        tau = high
    return tau, float(base["n"])


def source_weights(totals: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, tokens -> source, tokens, tau, weight, passes (how often the budget goes through the source)."""
    tau, n = _bracket(totals, mix)
    raw = F.when(F.col("tokens") > 0, F.exp(F.lit(tau) * F.log(F.col("tokens") / F.lit(max(n, 1.0))))).otherwise(F.lit(0.0))
    weighed = totals.select("source", "tokens", F.lit(tau).alias("tau"), raw.alias("raw"))
    norm = weighed.agg(F.sum("raw").alias("z"), F.max(F.when(F.col("raw") > 0, F.col("tokens") / F.col("raw"))).alias("whole")).first()
    z, whole = norm["z"] or 1.0, norm["whole"] or 0.0
    budget = float(mix.budget_tokens) if mix.budget_tokens is not None else whole * z
    # with a stated budget the limit on passes holds too: what a source can't give is not given
    passes = F.when(F.col("tokens") > 0, F.least(F.lit(float(mix.max_passes)), F.round(F.lit(budget / z) * F.col("raw") / F.col("tokens"), 9)))
    return weighed.select("source", "tokens", "tau", (F.col("raw") / F.lit(z)).alias("weight"), F.coalesce(passes, F.lit(1.0)).alias("passes"))


def _hash(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of the parts, set apart by bars; nulls are empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _row(documents: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What the mix needs of a document besides its tokens."""
    return [
        F.coalesce(documents[source_col].cast("string"), F.lit("")).alias("source"),
        _hash(F.lit(mix.seed), documents[id_col], documents[text_col]).alias("h"),
    ]


def _dealt(mix: Mix) -> Column:
    return F.pmod(_hash(F.lit(mix.seed), F.col("h")), F.col("n_blocks")).cast("long")


def _block_order(mix: Mix, pass_no: Column) -> Column:
    return _hash(F.lit(mix.seed), F.col("source"), pass_no, F.col("block"))


def _position(mix: Mix, pass_no: Column) -> Column:
    return _hash(F.lit(mix.seed), F.col("h"), pass_no)


def _end(rows: DataFrame, *order: str) -> DataFrame:
    """rows: source, t (tokens), left, and columns to order by -> for each source the last row that begins before
    `left`, and what is left there. The rows of a source are few (see above)."""
    before = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    begun = rows.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0))).where("before < left")
    last = begun.groupBy("source").agg(F.max_by(F.struct(*order, (F.col("left") - F.col("before")).alias("left")), F.struct(*order)).alias("e"))
    return last.select("source", "e.*")


def _plan(rows: DataFrame, mix: Mix, scratch: Scratch) -> DataFrame:
    """rows: source, h, n_tokens -> for each source: n_blocks, whole passes, and the last place of the last pass
    (cut_order, cut_block, cut_position, cut_h; null: nothing is taken in it)."""
    totals = scratch.keep(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")), "totals")
    shares = source_weights(totals.select("source", "tokens"), mix).select("source", "passes")
    plan = totals.join(shares, "source").select(
        "source",
        F.ceil(F.col("n_rows") / F.lit(mix.block_rows)).cast("long").alias("n_blocks"),
        F.floor("passes").cast("int").alias("whole"),
        F.round((F.col("passes") - F.floor("passes")) * F.col("tokens")).cast("long").alias("left"),
    )
    plan = scratch.keep(plan, "shares")
    partial = plan.where("left > 0")
    placed = rows.join(partial, "source").withColumn("block", _dealt(mix))
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.first("whole").alias("whole"))
    blocks = scratch.keep(blocks.select("source", "block", "t", _block_order(mix, F.col("whole") + 1).alias("o")), "blocks")
    ends = partial.select("source", "left")
    for bits in (48, 36):
        inside = blocks.join(ends, "source")
        if bits == 36:
            inside = inside.where(F.shiftright("o", 48) == F.col("r"))
        ends = _end(inside.groupBy("source", F.shiftright("o", bits).alias("r")).agg(F.sum("t").alias("t"), F.first("left").alias("left")), "r")
    inside = blocks.join(ends, "source").where(F.shiftright("o", 36) == F.col("r"))
    ends = scratch.keep(_end(inside.select("source", "o", "block", "t", "left"), "o", "block"), "ends")
    last = placed.drop("left").join(ends, ["source", "block"]).withColumn("p", _position(mix, F.col("whole") + 1))
    cut = _end(last.groupBy("source", "p", "h").agg(F.sum("n_tokens").alias("t"), F.first("left").alias("left")), "p", "h")
    cut = ends.select("source", F.col("o").alias("cut_order"), F.col("block").alias("cut_block")).join(cut.select("source", F.col("p").alias("cut_position"), F.col("h").alias("cut_h")), "source")
    out = scratch.keep(plan.drop("left").join(cut, "source", "left"), "plan")
    scratch.only("plan")
    return out


def _passes(mix: Mix) -> Column:
    """How often a document is taken, from its row and its source's line of the plan."""
    last = F.col("whole") + 1
    place = F.struct(_block_order(mix, last), F.col("block"), _position(mix, last), F.col("h"))
    within = place <= F.struct("cut_order", "cut_block", "cut_position", "cut_h")
    return F.col("whole") + F.when(F.col("cut_order").isNotNull() & within, F.lit(1)).otherwise(F.lit(0))


def mix_sources(documents: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each taking of a document: doc_id, source, n_tokens, pass_no (from 1), block, block_order, position.

    `position` orders the documents of a block in a pass; (source, pass_no, block_order,
    position) is the order of the mix. See mixed_documents for the texts themselves.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    rows = scratch.keep(
        documents.select(documents[id_col].alias("doc_id"), *_row(documents, mix, id_col, text_col, source_col), token_count(documents[text_col]).alias("n_tokens")), "rows"
    )
    kept = Scratch(documents.sparkSession, "mix-plan")
    taken = rows.join(_plan(rows, mix, kept), "source").withColumn("block", _dealt(mix))
    taken = taken.withColumn("times", _passes(mix)).where("times >= 1")
    taken = taken.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "times")).alias("pass_no"), "block", "h")
    return taken.select(
        "doc_id", "source", "n_tokens", "pass_no", "block", _block_order(mix, F.col("pass_no")).alias("block_order"), _position(mix, F.col("pass_no")).alias("position")
    )


def mixed_documents(documents: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """documents, each row as often as the mix takes it; no text is shuffled."""
    own = Scratch(documents.sparkSession, "mix")
    rows = own.keep(documents.select(*_row(documents, mix, id_col, text_col, source_col), token_count(documents[text_col]).alias("n_tokens")), "rows")
    plan = _plan(rows, mix, Scratch(documents.sparkSession, "mix-plan"))
    own.only()
    whole = documents.select(F.struct("*").alias("row"), *_row(documents, mix, id_col, text_col, source_col))
    taken = whole.join(plan, "source").withColumn("block", _dealt(mix)).withColumn("times", _passes(mix)).where("times >= 1")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
