"""Chat formatting from typed content parts, in DataFrame expressions only.

A message holds parts (text, image, audio, document). A visitor - one `transform` over
the parts, with a branch per kind - turns each into its piece of the output: escaped
text, or a placeholder for an attachment. Attachments are recorded by ordinal, with the
number of tokens that the placeholder expands to. The loss mask is the spans of `formatted`
that are learnt from; the text under it is cut from `formatted` by them.

Escaping: `~` becomes `~~`, and a `~` goes behind the first character of every control
string (`</s>` -> `<~/s>`). Unescaping takes away one `~` of each `~` or `~~`, from the
left; so every text comes back as it was, and no control string occurs inside a text. A text
part that ends like the beginning of a control string, with another text part behind it, gets a
`~` at its end: no control string forms across parts.

Defined results: null text, role or parts: empty; unknown kinds: a placeholder of no
tokens; null turns sort first; ties of turn go by role, then by the parts; equal rows stay as
often as they occur; a null conv_id is a conversation; no messages: no row; input columns of
other names are ignored; very long texts count whole. One conversation is one output row, so a
conversation must fit a row (2 GB); rows are gathered by map-side partial aggregation. Cutting
by the mask takes time in proportion to spans times length of a conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("ref", T.StringType()),
            T.StructField("units", T.DoubleType()),
        ]
    )
)


@dataclass(frozen=True)
class Template:
    """Turn marks, and tokens for each unit (image: tile, audio: second, document: page) of an attachment."""

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    tokens_per_unit: dict[str, float] = field(default_factory=lambda: {"image": 256.0, "audio": 25.0, "document": 640.0})
    #: Control strings of common templates, besides all that start as the turn marks do.
    controls: tuple[str, ...] = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")


TEMPLATE = Template()


def _quoted(literal: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in " _" else c for c in literal)


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    longest_first = sorted(template.controls, key=len, reverse=True)
    heads = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in longest_first)
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "~", "~~"), f"({heads})", "$1~")


def _guarded(escaped: Column, template: Template) -> Column:
    """An escaped text that another text follows: behind the beginning of a control string comes a mark."""
    starts = sorted({c[:k] for c in template.controls for k in range(1, len(c))}, key=lambda p: (-len(p), p))
    return F.when(escaped.rlike("(?:" + "|".join(map(_quoted, starts)) + r")\z"), F.concat(escaped, F.lit("~"))).otherwise(escaped)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "~(~?)", "$1")


def text_part(text: Column) -> Column:
    """One message's parts, for tables whose messages are plain text."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")
        )
    ).cast(PARTS)


def _visit(part: Column, follower: Column, template: Template) -> Column:
    """What a part becomes (the part behind it matters only in being a text): its string, and for attachments the kind, reference and expanded tokens."""
    kind = F.coalesce(part["kind"], F.lit("unknown"))
    rate = F.lit(0.0)
    for name, per_unit in template.tokens_per_unit.items():
        rate = F.when(kind == name, F.lit(per_unit)).otherwise(rate)
    is_text = kind == F.lit("text")
    known = kind.isin("image", "audio", "document")
    escaped = escape(part["text"], template)
    text_follows = F.coalesce(follower["kind"] == F.lit("text"), F.lit(False))
    return F.struct(
        F.when(is_text & text_follows, _guarded(escaped, template))
        .when(is_text, escaped)
        .otherwise(F.concat(F.lit("<|"), F.when(known, kind).otherwise(F.lit("unknown")), F.lit("|>")))
        .alias("piece"),
        is_text.alias("is_text"),
        kind.alias("kind"),
        part["ref"].alias("ref"),
        F.when(is_text, F.lit(0)).otherwise(F.ceil(F.coalesce(part["units"], F.lit(1.0)) * rate)).cast("long").alias("n_tokens"),
    )


def format_chat(messages: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, turn, role, parts -> conv_id, formatted, loss_spans, attachments, n_attachment_tokens.

    loss_spans: start (from 0) and length in characters of `formatted` of what is under the loss
    mask: the text parts of messages whose role is in template.loss_roles.
    attachments: ordinal (from 1, in order of the placeholders), kind, ref, n_tokens.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    visited = messages.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            F.transform(F.coalesce(F.col("parts"), F.array().cast(PARTS)), lambda p, i: _visit(p, F.get("parts", i + 1), template)).alias("parts"),
        ).alias("message"),
    )
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    per_message = lambda m: F.concat(
        F.array(piece(F.concat(F.lit(template.turn), escape(m["role"], template), F.lit(template.body)), F.lit(False))),
        F.transform(m["parts"], lambda p: piece(p["piece"], p["is_text"] & m["role"].isin(*template.loss_roles))),
        F.array(piece(F.lit(template.end + "\n"), F.lit(False))),
    )
    gathered = visited.groupBy("conv_id").agg(F.array_sort(F.collect_list("message")).alias("messages"))
    pieces = gathered.select(
        "conv_id",
        F.flatten(F.transform("messages", per_message)).alias("pieces"),
        F.filter(F.flatten(F.transform("messages", lambda m: m["parts"])), lambda p: ~p["is_text"]).alias("found"),
    )
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        _spans(F.col("pieces")).alias("loss_spans"),
        F.transform(
            "found", lambda p, i: F.struct((i + 1).alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens"))
        ).alias("attachments"),
        F.aggregate("found", F.lit(0).cast("long"), lambda n, p: n + p["n_tokens"]).alias("n_attachment_tokens"),
    )


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """Read `formatted` back: array of struct(role, text), unescaped."""
    pattern = f"(?s){_quoted(template.turn)}(.*?){_quoted(template.body)}(.*?){_quoted(template.end)}"
    both = F.arrays_zip(
        F.regexp_extract_all(formatted, F.lit(pattern), 1).alias("role"), F.regexp_extract_all(formatted, F.lit(pattern), 2).alias("text")
    )
    return F.transform(both, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def _spans(pieces: Column) -> Column:
    """Where the pieces under the loss mask lie in the concatenation."""
    span = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.filter(F.array(span), lambda s: s["start"] < 0).alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        size = F.length(piece["text"]).cast("long")
        here = F.array(F.struct(state["at"].alias("start"), size.alias("length")))
        return F.struct((state["at"] + size).alias("at"), F.when(piece["loss"] & (size > 0), F.concat(state["spans"], here)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda state: state["spans"])


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, cut from `formatted` and unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
