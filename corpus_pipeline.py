"""The corpus pipeline: five operators in order, each stage on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents. A stage leaves no more in the shared folder than the narrow tables that its frame
still reads (verdicts, group heads, digests of repeated windows, the mix by source).

Defined results for every stage: null texts are empty and rows without a doc_id are rows of
their own, by the operators' own verdicts (judged by quality_rules, near duplicates of nothing,
not cut, mixed and encoded); extra columns are dropped, whatever their names; an empty table
gives no rows; very long texts are worked on whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import bpe, jaccard, mixing, rules, substrings
from harrow.scratch import Scratch
from harrow.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go. Each row is judged by itself, repeated ones alike."""
    return rules.kept_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id. Rows that repeat its id are copies
    (the one with the smallest text stays); rows without an id all stay."""
    groups = jaccard.jaccard_components(docs.select(*COLUMNS))
    heads = Scratch(spark, "heads").keep(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "heads")
    kept = docs.select(*COLUMNS).join(heads.select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)
    # only where rows repeat an id do the texts move to meet each other
    if not heads.where("n > 1").isEmpty():
        one = F.min(F.struct("text", "lang", "source", "n_chars"))
        kept = kept.groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.*")
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; n_chars follows the text, null where it is null."""
    cut = substrings.dedup_substrings(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of the smaller sources as often again as the mix takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with what they decode to as a digest; a row of its own for each row."""
    encoded = bpe.encode_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: BPE and chunking are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
