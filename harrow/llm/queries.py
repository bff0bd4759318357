"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.session import table


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import chat

    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(probe).alias("text"),
    )
    messages = rows.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    out = chat.format_chat(messages).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import rules

    ruled = rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join(F.array_sort("failed_rules"), ",").alias("failed_rules"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import mixing

    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from harrow.llm import bpe

    encoded = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose a passage: doc_id, spans in characters of the old text, and what stays."""
    from harrow.llm import substrings

    done = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return done.select("doc_id", F.size("removed").alias("n_spans"), removed.alias("removed_chars"), F.length("text").cast("long").alias("kept_chars"), "removed", "text").where(
        "n_spans > 0"
    )


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import jaccard

    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import ann

    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import licenses

    scanned = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return scanned.select("doc_id", "license", F.round("score", 6).alias("score"), F.size("finds").cast("long").alias("n_finds"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import toxicity

    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0)
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import quality

    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held=1)


def op11_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import sharding

    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    from harrow.llm import codes

    done = codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    books = hashlib.sha256(done.book_text().encode()).hexdigest()
    code = F.lower(F.array_join(F.transform("entries", lambda e: F.lpad(F.hex(e.cast("long")), 2, "0")), ""))
    return codes.with_label_error(done.codes).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books).alias("codebooks_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import phrases

    return phrases.top_phrases(phrases.mine_phrases(table(spark, sf_dir, "documents"), least=100, longest=5), most=2000)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_bpe_encode": op3_bpe_encode,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_quality": op5_line_quality,
    "op6_mix_sources": op6_mix_sources,
    "op7_one_bit_neighbours": op7_one_bit_neighbours,
    "op8_chat_format": op8_chat_format,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_quality_rules": op10_quality_rules,
    "op11_byte_shards": op11_byte_shards,
    "op12_vector_codes": op12_vector_codes,
    "op13_collocations": op13_collocations,
}
