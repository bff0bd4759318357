"""Contiguous shards of nearly equal bytes, by prefix sums over one global order of the documents.

The order is by content: first 60 bits of the text's MD5, then id, then the other narrow columns,
so rows of equal text stand side by side and a shard is a fair mix of the corpus. Narrow rows
(no text) are dealt into ranges of that order; inside a range a running sum gives each row the
bytes and rows before it, the totals of the ranges (one row each) are summed up the same way,
and both together are the row's place in the whole order. The order is then cut at equal
targets of bytes, so a shard is one unbroken stretch of it.

A target falls inside some row. Rows of equal text around it form a group; a group of no more
bytes than the largest document (or a hundredth of a shard) goes whole to the side of the cut on
which most of it lies, a larger one is cut between two rows, at the row's nearer end. So a shard
is off its target by one such document or group at most, equal texts share a shard as far as
equal sizes allow, and a group of any size is spread over ranges and shards.

Scale: one shuffle of narrow rows by range and one by range number; no task holds more than
its range, as the order's last columns tell copies apart by id. To the driver come the totals
(one row) and, for each cut, the row that it meets.

Defined results: null texts have no bytes (size 1, crc32 of nothing: 0) and form one group with
empty texts; null ids come first in a group; rows alike in everything are rows of their own;
very long texts count whole, and where one is longer than a shard's target some shards may be
empty; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.scratch import Scratch

ORDER = ["digest", "doc_id", "size", "text_crc32"]


def content_digest(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text's UTF-8 bytes; null: as of an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _placed(documents: DataFrame, scratch: Scratch, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """Narrow rows with `start` (bytes before the row in the whole order) and `place` (rows before it)."""
    spark = documents.sparkSession
    text = documents[text_col].cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    narrow = documents.select(
        content_digest(text).alias("digest"),
        documents[id_col].cast("long").alias("doc_id"),
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        *([F.struct(*[documents[c] for c in carry]).alias("row")] if carry else []),
    )
    ranges = narrow.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *ORDER).withColumn("range", F.spark_partition_id())
    inside = Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    local = ranges.withColumns({"start": F.coalesce(F.sum("size").over(inside), F.lit(0)), "place": F.count("*").over(inside)})
    local = scratch.keep(local, "ranges")
    # a row for each range: their number is set by the session, not by the documents
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    bases = totals.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"))
    bases = scratch.keep(bases, "bases")
    joined = local.join(F.broadcast(bases), "range")
    return joined.withColumns({"start": F.col("start") + F.col("bytes"), "place": F.col("place") + F.col("rows")}).drop("range", "bytes", "rows")


def _cuts(placed: DataFrame, shards: int) -> list[int]:
    """The places (rows before them) at which shards 1 and following begin, in ascending order."""
    total = placed.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("largest")).first()
    if not total["rows"]:
        return [0] * (shards - 1)
    # targets are compared times the number of shards, so that they are whole numbers
    targets = F.array(*[F.lit(k * total["bytes"]) for k in range(1, shards)])
    at, till = F.col("start") * shards, (F.col("start") + F.col("size")) * shards
    met = placed.select("digest", "start", "size", "place", F.explode(F.filter(targets, lambda t: (at <= t) & (t < till))).alias("target"))
    rows = {r["target"]: r for r in met.collect()}  # one for each cut
    groups = placed.where(F.col("digest").isin(sorted({r["digest"] for r in rows.values()}))).groupBy("digest")
    groups = groups.agg(F.min("start").alias("start"), F.sum("size").alias("size"), F.min("place").alias("place"), F.count("*").alias("n"))
    whole = {g["digest"]: g for g in groups.collect()}
    cuts = []
    for k in range(1, shards):
        row = rows[k * total["bytes"]]
        group = whole[row["digest"]]
        small = group["size"] <= max(total["largest"], total["bytes"] // (100 * shards))
        start, size, place, n = (group["start"], group["size"], group["place"], group["n"]) if small else (row["start"], row["size"], row["place"], 1)
        cuts.append(place if 2 * k * total["bytes"] <= (2 * start + size) * shards else place + n)
    return cuts


def assign_shards(documents: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard (from 0), slot (the row's place in its shard, from 0 without gaps).

    `carry` names columns of documents that come along, as a struct `row`.
    """
    scratch = Scratch(documents.sparkSession, "shards")
    placed = _placed(documents, scratch, id_col, text_col, list(carry or []))
    cuts = _cuts(placed, shards)
    starts = F.array(*[F.lit(c).cast("long") for c in [0, *cuts]])
    shard = F.size(F.filter(starts, lambda c: c <= F.col("place"))) - 1
    out = placed.withColumn("shard", shard).withColumn("slot", F.col("place") - F.element_at(starts, F.col("shard") + 1))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", *(["row"] if carry else []))


def write_shards(documents: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", files: int = 1) -> None:
    """Whole documents as Parquet under path/shard=k, each shard's rows in the order of their slots, in `files` files each."""
    placed = assign_shards(documents, shards, id_col, text_col, documents.columns)
    ordered = placed.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("shard", "slot", "row").write.partitionBy("shard").parquet(path)
