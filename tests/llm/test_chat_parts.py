"""Control strings can't form across parts; the loss mask is spans of the output."""

import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

PARTS = "conv_id long, turn long, role string, parts array<struct<kind string, text string, ref string, units double>>, formatted string, piece string"


def test_no_control_string_forms_across_parts(spark):
    from harrow.llm import chat

    cuts = [(c[:k], c[k:]) for c in [*chat.TEMPLATE.controls, "<|end|>", "<|image|>", "<|turn|>", "<|body|>"] for k in range(1, len(c))]
    cuts += [("<", "|end|>\n<|turn|>"), ("<", "", "|image|>"), ("[I", "N", "ST]"), ("<~", "|end|>"), ("~", "<", "~|"), ("<", "~~", "|"), ("", ""), ("[INS", None, "T]")]
    rng = random.Random(4)
    cuts += [tuple("".join(rng.choice("<|>~/s[]INST") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    rows = [(i, t, role, [("text", p, None, None) for p in parts], "clash", "clash") for i, parts in enumerate(cuts) for t, role in enumerate(["user", "assistant"])]
    rows += [(-5, 0, "assistant", [("text", "<", None, None), ("image", None, "r", 1.0), ("text", "|turn|>", None, None)], None, None)]
    out = chat.format_chat(spark.createDataFrame(rows, PARTS))
    out = out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(out) == len(cuts) + 1
    for r in out:
        if r["conv_id"] < 0:
            assert r["formatted"] == "<|turn|>assistant<|body|><<|image|>|turn|><|end|>\n" and r["loss"] == "<|turn|>"
            continue
        text = "".join(p or "" for p in cuts[r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", text), ("assistant", text)], text
        assert r["loss"] == text
        inside = r["formatted"].replace("<|turn|>user<|body|>", "\0", 1).replace("<|turn|>assistant<|body|>", "\0", 1).replace("<|end|>\n", "\0", 2)
        assert not any(c in inside for c in chat.TEMPLATE.controls)


def test_long_texts_ties_and_empty_tables(spark):
    from harrow.llm import chat

    long = "<|x é~ " * 150_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, None, "assistant", "b"), (2, None, "assistant", "a"), (2, 1, "assistant", "c"), (None, 0, "assistant", "n")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_chat(messages).select("conv_id", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert {r["conv_id"]: r["loss"] for r in out} == {1: long, 2: "abc", None: "n"}
    assert chat.format_chat(messages.limit(0)).count() == 0


def test_spans_against_plain_python(spark):
    from harrow.llm import chat

    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["", "x", "~<|", None, "aß😀" * 5])) for c, t in itertools.product(range(20), range(5))]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    want = defaultdict(list)
    for c, _, role, text in rows:
        if role == "assistant" and text:
            want[c].append(text)
    for r in chat.format_chat(messages).collect():
        cut = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert [x.replace("~~", "\0").replace("~", "").replace("\0", "~") for x in cut] == want[r["conv_id"]]
