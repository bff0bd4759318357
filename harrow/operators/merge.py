"""Merging: ordered evidence folds, first wins, scope replacement, revisits, upserts, tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import text as tx
from harrow.functions import urls
from harrow.functions.text import non_empty


def first_wins(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """Distinct by composite key: the first row in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def union_in_order(*parts: DataFrame) -> DataFrame:
    """Union with `part` (0, 1, ...) as the leading order; missing columns are null."""
    out = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("part", F.lit(i)), allowMissingColumns=True)
    return out


def quality_score(confidence: Column, from_social: Column, has_host: Column, has_deadline: Column, has_result: Column) -> Column:
    """What decides which of two records is the primary one."""
    plus = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    return F.coalesce(confidence, F.lit(0.0)) + plus(~from_social, 0.3) + plus(has_host, 0.15) + plus(has_deadline, 0.1) + plus(has_result, 0.05)


#: So many merges lift any confidence to 0.99.
HEAD = 32


def merge_evidence(rows: DataFrame, key: str, order: list[str], bonus: Column, kind: str, confidence: str, payload: list[str]) -> DataFrame:
    """Ordered left fold of each key's rows into one: key, payload columns, kinds, evidence, confidence.

    A row takes the lead only with a strictly higher quality (confidence so far + its bonus); the
    leader's payload overrides, empty strings too. Each merge unites the kinds (leader's first),
    adds the evidence, and lifts the confidence: min(0.99, larger of both + 0.04), two decimals.
    The fold isn't commutative, but it settles: each merge lifts the confidence by 0.04, so after
    HEAD rows it is 0.99 for good. From then on a row of confidence 0.99 or less takes the lead only
    with a higher bonus than the leader's, so of rows that agree in confidence, bonus and kind only
    the first can matter. A key's list is its first HEAD rows and one row for each such
    combination, with how many it stands for, however many rows the key has. (Rows of a
    confidence above 0.99 stay as they are.) `order` has no ties within a key.
    """
    item = F.struct(*[F.col(o) for o in order], F.coalesce(F.col(confidence), F.lit(0.0)).cast("double").alias("c"), bonus.cast("double").alias("b"), F.array(F.col(kind)).alias("k"), F.lit(1).cast("long").alias("e"), F.struct(*payload).alias("p"))
    place = F.struct(*order)
    items = rows.select(key, place.alias("_o"), item.alias("_i"))
    head = items.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_o"))).where(F.col("_r") <= HEAD)
    settled = head.groupBy(key).agg(F.max("_o").alias("_last"), F.count("*").alias("_n")).where(F.col("_n") == HEAD).select(F.col(key).alias("_key"), "_last")
    later = items.join(settled, F.col(key).eqNullSafe(F.col("_key"))).where(F.col("_o") > F.col("_last"))
    apart = F.when(F.col("_i.c") > 0.99, F.col("_o"))
    later = later.groupBy(key, F.col("_i.c").alias("_c"), F.col("_i.b").alias("_b"), F.col("_i.k").alias("_k"), apart.alias("_a")).agg(F.min_by("_i", "_o").alias("_i"), F.count("*").alias("_e"))
    later = later.select(key, F.col("_i").withField("e", F.col("_e")).alias("_i"))
    grouped = head.select(key, "_i").unionByName(later).groupBy(key).agg(F.array_sort(F.collect_list("_i")).alias("_all"))
    strip = lambda r: F.struct(r["c"].alias("c"), r["b"].alias("b"), r["k"].alias("k"), r["e"].alias("e"), r["p"].alias("p"))

    def step(a: Column, r: Column) -> Column:
        lead = r["c"] + r["b"] > a["c"] + a["b"]
        return F.struct(
            F.round(F.least(F.lit(0.99), F.greatest(a["c"], r["c"]) + F.lit(0.04)), 2).alias("c"),
            F.when(lead, r["b"]).otherwise(a["b"]).alias("b"),
            F.when(lead, F.array_union(r["k"], a["k"])).otherwise(F.array_union(a["k"], r["k"])).alias("k"),
            (a["e"] + r["e"]).alias("e"),
            F.when(lead, r["p"]).otherwise(a["p"]).alias("p"),
        )

    folded = grouped.select(key, F.aggregate(F.slice("_all", F.lit(2), F.size("_all")), strip(F.element_at("_all", 1)), step).alias("m"))
    return folded.select(key, "m.p.*", F.col("m.k").alias("kinds"), F.col("m.e").alias("evidence"), F.col("m.c").alias("confidence"))


def replace_scopes(previous: DataFrame, current: DataFrame, scope: str) -> DataFrame:
    """Previous rows whose scope doesn't come again among the current ones; rows without a scope stay."""
    again = current.where(F.col(scope).isNotNull() & (F.col(scope) != "")).select(scope).distinct()
    keyed = previous.where(F.col(scope).isNotNull() & (F.col(scope) != ""))
    return keyed.join(again, scope, "left_anti").select(*previous.columns).unionByName(previous.where(F.col(scope).isNull() | (F.col(scope) == "")))


def revisit(previous: DataFrame, seen: DataFrame, group: str, url: str, newest: str, most: int = 6, tie: str | None = None) -> DataFrame:
    """Per group the newest known addresses that weren't seen now: each address once, at most `most` (clamped to 1..12)."""
    most = max(1, min(12, most))
    by = [F.desc(newest)] + ([F.asc(tie)] if tie else [])
    left = previous.where(F.col(url) != "").join(seen.select(group, url).distinct(), [group, url], "left_anti")
    once = first_wins(left, [group, url], by)
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("rank") <= most)


def merge_candidates(discovered: DataFrame, revisited: DataFrame, key: str, text: str) -> DataFrame:
    """Full union by key: the later side's fields override, texts are joined."""
    a, b = discovered.select(key, F.col(text).alias("_a"), F.col("score").alias("_sa")), revisited.select(key, F.col(text).alias("_b"), F.col("score").alias("_sb"))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.trim(F.concat_ws(" ", "_a", "_b")).alias(text), F.coalesce("_sb", "_sa").alias("score"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, complete: Column) -> DataFrame:
    """Merge by key: incoming non-empty fields override, arrays are united; status update, keep, insert or review (incomplete new rows).

    Both frames have the same columns. Parquet has no MERGE: the result is a new version to write beside the old.
    """
    left = existing.select(F.col(key), F.struct(*existing.columns).alias("_old"))
    right = incoming.select(F.col(key), F.struct(*existing.columns).alias("_new"), complete.alias("_complete"))
    both = left.join(right, key, "full_outer")
    fields = []
    for f in existing.schema.fields:
        if f.name == key:
            continue
        old, new = F.col("_old")[f.name], F.col("_new")[f.name]
        kind = f.dataType.simpleString()
        if kind.startswith("array"):
            value = F.array_distinct(F.concat(F.coalesce(old, F.array().cast(kind)), F.coalesce(new, F.array().cast(kind))))
        elif kind == "string":
            value = F.coalesce(F.nullif(new, F.lit("")), old)
        else:
            value = F.coalesce(new, old)
        fields.append(value.alias(f.name))
    status = (
        F.when(F.col("_new").isNull(), "keep").when(F.col("_old").isNotNull(), "update").when(F.coalesce(F.col("_complete"), F.lit(False)), "insert").otherwise("review")
    )
    return both.select(key, *fields, status.alias("status"))


def merge_products(rows: DataFrame, key: str, order: str, first_fields: list[str], last_fields: list[str], aliases: str, confidence: str) -> DataFrame:
    """Candidates of a key: last value of some fields, first non-empty of others, united aliases in order, largest confidence."""
    filled = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct(F.col(order), F.col(c).alias("v")))
    united = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(aliases).alias("a")))), lambda s: s["a"])))
    return rows.groupBy(key).agg(
        *[F.min(filled(c))["v"].alias(c) for c in first_fields], *[F.max(filled(c))["v"].alias(c) for c in last_fields], united.alias(aliases), F.max(confidence).alias(confidence)
    )


def latest_wins(rows: DataFrame, key: str, stamps: list[str], order: str, created: str) -> DataFrame:
    """The newest row of a key (later row of equal stamps), with `created` from the oldest one."""
    stamp = non_empty(*[F.col(s).cast("string") for s in stamps])
    rest = [c for c in rows.columns if c not in (key, created)]
    w = rows.withColumn("_s", F.struct(stamp.alias("s"), F.col(order).alias("o")))
    out = w.groupBy(key).agg(F.max_by(F.struct(*rest), "_s").alias("r"), F.min_by(created, "_s").alias(created), F.count("*").alias("versions"))
    return out.select(key, "r.*", created, "versions")


def prune_missing(rows: DataFrame, keys_now: DataFrame, key: str, managed: Column, authoritative: Column) -> DataFrame:
    """Rows of an authoritative feed whose key is gone are dropped; others, and rows without a key, stay."""
    now = keys_now.select(key).distinct().withColumn("_there", F.lit(True))
    marked = rows.join(now, key, "left")
    gone = managed & authoritative & F.col(key).isNotNull() & (F.col(key) != "") & F.col("_there").isNull()
    return marked.where(~F.coalesce(gone, F.lit(False))).select(*rows.columns)


def drop_stale_tombstones(tombstones: DataFrame, live: DataFrame, key: str, newest: str, most: int = 500) -> DataFrame:
    """Tombstones whose key isn't live again, the newest `most` of them."""
    return tombstones.join(live.select(key).distinct(), key, "left_anti").orderBy(F.desc(newest), key).limit(most)


def enrich_applications(items: DataFrame, readings: DataFrame, hosts: tuple[str, ...] = ("livepocket.jp", "forms.gle", "docs.google.com", "forms.google.com"), kept: tuple[str, ...] = ("externalId", "xPostId", "xAuthor", "sourceUrl"), country: str = "全国", least: float = 0.9) -> DataFrame:
    """items whose address is an application's, with what was read from its page: the page's filled fields go before the item's own, but for `kept`; the area
    only if it isn't the whole country; memos of both; the greater confidence, at least `least`; `enriched` tells which. Items elsewhere, or whose page
    gave nothing, stay as they are.

    items: url, confidence, memo, area, and columns that readings (url, ord, fields) may have as well. Addresses are compared by identity; of several
    readings of an address the first (ord) counts.
    """
    own = urls.host_under(urls.host(F.col("url")), list(hosts))
    fields = [c for c in readings.columns if c in items.columns and c not in {"url", *kept}]
    first = readings.groupBy(urls.identity_url(F.col("url")).alias("_at")).agg(F.min_by(F.struct(*fields), "ord").alias("_r"))
    both = items.withColumn("_at", F.when(own, urls.identity_url(F.col("url")))).join(first, "_at", "left")
    there = F.col("_r").isNotNull()

    def taken(c: str) -> Column:
        mine, read = F.col(c), F.col(f"_r.{c}")
        if c == "area":
            return F.when(there & (tx.non_empty(read) != "") & (read != country), read).otherwise(mine)
        if c == "memo":
            return F.when(there, F.array_join(F.filter(F.array(mine, read), lambda m: tx.non_empty(m) != ""), "\n")).otherwise(mine)
        if c == "confidence":
            return F.when(there, F.greatest(F.coalesce(mine, F.lit(0.0)), F.coalesce(read, F.lit(0.0)), F.lit(least))).otherwise(mine)
        filled = read.isNotNull() & (read.cast("string") != "")
        return F.when(there & filled, read).otherwise(mine)

    return both.select(*[taken(c).alias(c) if c in fields else F.col(c) for c in items.columns], F.coalesce(there, F.lit(False)).alias("enriched"))
