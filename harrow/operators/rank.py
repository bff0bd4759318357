"""Ranking idioms: argmax with ties, scored lines with alternatives, top-k by score, title choice, release order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pattern_score(value: Column, rules: list[tuple[str, int]]) -> Column:
    """Sum of the points of all patterns that are found."""
    total = F.lit(0)
    for pattern, points in rules:
        total = total + F.when(value.rlike(pattern), F.lit(points)).otherwise(F.lit(0))
    return total


def best_of(rows: DataFrame, group: list[str], value: str, score: Column, order: str) -> DataFrame:
    """The value with the highest score of each group, the first of equal ones: one partial aggregate, no window."""
    scored = rows.withColumn("_s", score)
    best = F.max_by(F.struct(F.col(value), F.col("_s").alias("score")), F.struct(F.col("_s"), -F.col(order)))
    return scored.groupBy(*group).agg(best.alias("b")).select(*group, "b.*")


def best_with_alternatives(rows: DataFrame, group: list[str], value: str, score: Column, order: str, near: int = 18, most: int = 8) -> DataFrame:
    """Per group the best value (score, then length, then order) and `alternatives`: other distinct values within `near` points of it, at most `most` in all."""
    scored = rows.withColumn("_s", score)
    once = scored.groupBy(*group, value).agg(F.max("_s").alias("_s"), F.min(order).alias("_o"))
    w = Window.partitionBy(*group).orderBy(F.desc("_s"), F.desc(F.length(value)), F.asc("_o"))
    ranked = once.withColumn("_r", F.row_number().over(w)).withColumn("_top", F.max("_s").over(Window.partitionBy(*group))).where(F.col("_r") <= most)
    others = F.array_sort(F.collect_list(F.when((F.col("_r") > 1) & (F.col("_s") >= F.col("_top") - near), F.struct("_r", value))))
    return ranked.groupBy(*group).agg(F.min_by(value, "_r").alias(value), F.max("_s").alias("score"), F.transform(others, lambda x: x[value]).alias("alternatives"))


def consensus_key(name: Column) -> Column:
    """What names have in common that differ by case, blanks, brackets, points and dashes only; the name is in NFKC."""
    return F.regexp_replace(F.lower(name), r"[\s\x{3000}「」『』【】［］\[\]()（）・･\-‐‑‒–—―_]", "")


def consensus(candidates: Column, near: int = 18, most: int = 8, size_first: bool = False) -> Column:
    """candidates: array of (name, score, i) -> struct(name, score, names, contested).

    Names that are one by their consensus key count once, at their best place. They are ranked by score, then (`size_first`) the
    longer name, then i; `names` are the first `most`, `name` the first ("" without any), `contested` whether the second is within `near` points of it.
    """
    size = lambda c: -F.length(c["name"]) if size_first else F.lit(0)
    placed = F.transform(candidates, lambda c: F.struct((-c["score"]).alias("down"), size(c).alias("size"), c["i"].alias("i"), c["name"].alias("name"), consensus_key(c["name"]).alias("key")))

    def read(ranked: Column) -> Column:
        keys = F.slice(F.array_distinct(F.filter(F.transform(ranked, lambda c: c["key"]), lambda k: k != "")), 1, most)
        return F.transform(keys, lambda k: F.get(F.filter(ranked, lambda c: c["key"] == k), F.lit(0)))

    def told(first: Column) -> Column:
        top, second = F.get(first, F.lit(0)), F.get(first, F.lit(1))
        contested = F.coalesce(second["down"] <= top["down"] + near, F.lit(False))
        return F.struct(F.coalesce(top["name"], F.lit("")).alias("name"), (-top["down"]).alias("score"), F.transform(first, lambda c: c["name"]).alias("names"), contested.alias("contested"))

    one = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return one(one(F.array_sort(placed), read), told)


def choice_confidence(score: Column, contested: Column, share: float = 220.0, least: float = 0.55, most: float = 0.86, tied: float = 0.68) -> Column:
    """How sure a choice is: by its score within bounds, a fixed value where another is near it, 0 without one."""
    return F.when(score.isNull(), 0.0).when(contested, tied).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), score / F.lit(share))))


def consensus_choice(rows: DataFrame, group: list[str], value: str, key: Column, score: Column, order: str, near: int = 18, most: int = 8, salts: int = 16) -> DataFrame:
    """Per group the best value with its score, the distinct values by consensus key (`names`, at most `most`) and `confidence`.

    Values are folded by key first (score, then length, then order); what is ranked then is at most `most` of each of a group's `salts` shares.
    Values with an empty key don't count. Groups without any have no row.
    """
    by = lambda: F.struct(F.col("_s"), F.length(F.col(value)), -F.col(order))
    keyed = rows.withColumns({"_s": score, "_k": key}).where("_k != ''")
    once = keyed.groupBy(*group, "_k").agg(F.max_by(F.struct(value, "_s", order), by()).alias("b")).select(*group, "_k", "b.*")
    down = [F.desc("_s"), F.desc(F.length(value)), F.asc(order)]
    share = F.pmod(F.xxhash64("_k"), F.lit(salts))
    few = once.withColumn("_share", share).withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_share").orderBy(*down))).where(F.col("_r") <= most)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*down))).where(F.col("_r") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v"), "_s"))).alias("l")
    told = few.groupBy(*group).agg(listed).withColumn("contested", F.coalesce(F.get("l", F.lit(1))["_s"] >= F.get("l", F.lit(0))["_s"] - near, F.lit(False)))
    top = F.get("l", F.lit(0))
    return told.select(*group, top["v"].alias(value), top["_s"].alias("score"), F.transform("l", lambda x: x["v"]).alias("names"), choice_confidence(top["_s"], F.col("contested")).alias("confidence"))


def top_by_score(rows: DataFrame, group: list[str], score: Column, order: str, least: int, most: int) -> DataFrame:
    """Rows that score more than `least`, the best `most` of each group, with score and rank."""
    w = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc(order))
    return rows.withColumn("score", score).where(F.col("score") > least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def best_title(rows: DataFrame, group: list[str], title: str, exact: Column, priority: Column, score: Column, order: str) -> DataFrame:
    """Title by: exact target first, then source priority, then the score (among exact ones only), then order."""
    by = F.struct((~exact).alias("a"), (-priority).alias("b"), F.when(exact, -score).otherwise(F.lit(0)).alias("c"), F.col(order).alias("d"))
    return rows.groupBy(*group).agg(F.min_by(title, by).alias(title))


def newest_first(rows: DataFrame, stamp: str, tie: str) -> DataFrame:
    """Feed order: newest first, given order among equal ones."""
    return rows.orderBy(F.desc(stamp), F.asc(tie))


def release_order(rows: DataFrame, date: str, name: str) -> DataFrame:
    """Catalog order: newest release first, names in Japanese order."""
    return rows.orderBy(F.desc(date), F.collate(F.col(name), "ja"))
