"""Newness of sources and candidates over runs: first seen, changed, known; metrics; retention. Batch form; see streaming.newness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newness(observed: DataFrame, key: str, run: str, fingerprint: str, tie: str | None = None) -> DataFrame:
    """observed, one row per key and run, with first_seen, changed, and first_seen_at / last_changed_at so far."""
    order = [F.asc(run)] + ([F.asc(tie)] if tie else [])
    w = Window.partitionBy(key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag(fingerprint).over(w)
    marked = observed.withColumn("first_seen", F.row_number().over(w) == 1).withColumn("changed", F.coalesce(before != F.col(fingerprint), F.lit(False)))
    return marked.withColumn("first_seen_at", F.min(run).over(so_far)).withColumn("last_changed_at", F.max(F.when(F.col("first_seen") | F.col("changed"), F.col(run))).over(so_far))


def apply_run(state: DataFrame, observed: DataFrame, now: Column) -> DataFrame:
    """One run: state (key, first_seen_at, last_seen_at, last_changed_at, fingerprint) joined with what was observed (key, fingerprint).

    Rows that weren't observed stay as they are; outcome tells new, changed, known or unseen.
    """
    s, o = state.alias("s"), observed.groupBy("key").agg(F.max("fingerprint").alias("fingerprint")).alias("o")
    both = s.join(o, F.col("s.key") == F.col("o.key"), "full_outer")
    seen = F.col("o.key").isNotNull()
    is_new = seen & F.col("s.key").isNull()
    changed = seen & F.col("s.key").isNotNull() & ~F.col("s.fingerprint").eqNullSafe(F.col("o.fingerprint"))
    return both.select(
        F.coalesce("s.key", "o.key").alias("key"),
        F.coalesce(F.col("s.first_seen_at"), now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("s.last_seen_at")).alias("last_seen_at"),
        F.when(is_new | changed, now).otherwise(F.col("s.last_changed_at")).alias("last_changed_at"),
        F.coalesce("o.fingerprint", "s.fingerprint").alias("fingerprint"),
        F.when(is_new, "new").when(changed, "changed").when(seen, "known").otherwise("unseen").alias("outcome"),
    )


def metrics(marked: DataFrame) -> DataFrame:
    """Counts over newness(): known rows include changed ones."""
    return marked.agg(
        F.count("*").alias("observed"), F.count_if("first_seen").alias("new"), F.count_if(~F.col("first_seen")).alias("known"), F.count_if("changed").alias("changed")
    )


def retain(state: DataFrame, group: str, last_seen: str, now: Column, days: int = 180, most: int = 1000, tie: str = "key") -> DataFrame:
    """Rows seen within `days` (unreadable times stay), the newest `most` of a group."""
    recent = state.where(F.col(last_seen).isNull() | (F.col(last_seen) >= now - F.make_dt_interval(F.lit(days))))
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(last_seen), F.asc(tie))
    return recent.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
