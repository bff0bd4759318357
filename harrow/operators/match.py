"""Lookups: best match by containment, longest label, group expansion, first-match profiles, unique matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.scratch import Scratch


#: As many grams of parts are sent to every task (a number of eight bytes each); more meet the holders' in a shuffle.
BROADCAST_GRAMS = 2_000_000
#: The longest grams that strings are looked up by.
LONGEST_GRAM = 32


def label_table(catalog: DataFrame, id_col: str, labels: Column) -> DataFrame:
    """catalog rows -> id, ordinal, label; labels is an array column, in order of preference."""
    return catalog.select(F.col(id_col).alias("id"), F.posexplode(labels).alias("ordinal", "label"))


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of so many characters, by way of an array of characters: linear in the text."""
    of = lambda chars: F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.array_join(F.slice(chars, i, F.lit(size)), ""))
    grams = F.element_at(F.transform(F.array(F.split(text, "")), of), 1)
    return F.when(F.length(text) >= size, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def best_match(values: DataFrame, value_col: str, labels: DataFrame, shortest: int = 4, row_cols: list[str] | None = None, generic: str | None = None) -> DataFrame:
    """The best label for each value, both sides normalised: values' key columns, id, label, score.

    labels: id, ordinal, key. Exact: 10000 + |key|; the value holds the key (of `shortest`
    characters or more): 2000 + |key| - 2 gap; the key holds the value: 1000 + |value| - 3 gap;
    ties to the earlier label (ordinal, id). Values under three characters match nothing.

    Containment has no equi-key, so pairs meet on grams: a string is looked up
    by its rarest gram (see _met_pairs). That is a hash join in both directions, never a product; gram
    rows hold hashes of the strings, which come back for the pairs that met.

    `generic` names a boolean column of values: those that only name a kind of goods. They match nothing but groups, labels whose
    `is_group` is true, and these only exactly; the earliest of equal ones. Groups match other values as any label does.
    """
    rows = row_cols or [c for c in values.columns if c not in (value_col, generic)]
    if generic:
        plain = best_match(values.where(~F.coalesce(F.col(generic), F.lit(False))), value_col, labels.select("id", "ordinal", "key"), shortest, rows)
        groups = labels.where("is_group and key != ''").groupBy(F.col("key").alias("_k")).agg(F.min(F.struct("ordinal", "id")).alias("_first"))
        named = values.where(F.col(generic) & (F.length(value_col) >= 3)).join(groups, F.col(value_col) == F.col("_k"))
        return plain.unionByName(named.select(*rows, "_first.id", F.col("_k").alias("label"), (10_000 + F.length("_k")).alias("score")))
    target = values.select(*rows, F.col(value_col).alias("_t")).where(F.length("_t") >= 3)
    first = F.max_by(F.struct("ordinal", "id"), F.struct(-F.col("ordinal"), -F.col("id"))).alias("_first")
    keys = labels.groupBy(F.col("key").alias("_k")).agg(first).where("_k != ''").select("_first.id", "_first.ordinal", "_k")
    exact = target.join(keys, F.col("_t") == F.col("_k"))
    texts = target.select("_t").distinct()
    pairs = _held_pairs(texts, "_t", keys.select("_k"), "_k", shortest).where(F.col("_t") != F.col("_k"))
    holds = target.join(pairs, "_t").join(keys, "_k")
    pairs = _held_pairs(keys.select("_k"), "_k", texts, "_t", shortest).where(F.col("_t") != F.col("_k"))
    inside = target.join(pairs, "_t").join(keys, "_k")
    gap = F.abs(F.length("_t") - F.length("_k"))
    cols = [*rows, "id", "ordinal", "_k"]
    scored = (
        exact.withColumn("score", 10_000 + F.length("_k")).select(*cols, "score")
        .unionByName(holds.withColumn("score", 2_000 + F.length("_k") - 2 * gap).select(*cols, "score"))
        .unionByName(inside.withColumn("score", 1_000 + F.length("_t") - 3 * gap).select(*cols, "score"))
    )
    # an argmax with a total order: partial aggregation, no window over a hot value
    best = scored.groupBy(*rows).agg(F.max_by(F.struct("id", F.col("_k").alias("label"), "score"), F.struct("score", -F.col("ordinal"), -F.col("id"))).alias("b"))
    return best.select(*rows, "b.*")


def _gram_size(text: Column) -> Column:
    """The largest power of two that isn't beyond the text's length: the more there is of a string, the fewer others share its grams."""
    out = F.lit(1)
    for n in range(1, LONGEST_GRAM.bit_length()):
        out = F.when(F.length(text) >= 1 << n, 1 << n).otherwise(out)
    return out


def _met_pairs(holders: DataFrame, holder: str, held: DataFrame, part: str, shortest: int) -> DataFrame:
    """Pairs (holder, part) that share the part's rarest gram; those where the holder contains the part are among them.

    A part is looked up by the one of its grams that the fewest holders have, by count; a part with a gram that none has is held by none.
    So a gram that all parts begin with, or that all holders have, brings no pairs together unless a part has nothing rarer. Grams are as
    long as the part allows (see _gram_size), so parts of any length are looked up, and long ones not by a few characters that many share.
    """
    mark = lambda c: F.xxhash64(c)
    scratch = Scratch(holders.sparkSession, "grams")
    parts = held.where(F.length(part) >= max(shortest, 1)).select(F.col(part).alias("_s"), _gram_size(F.col(part)).alias("_size"))
    sizes = sorted(r["_size"] for r in parts.select("_size").distinct().collect())
    none = F.array().cast("array<string>")
    own = none
    for n in sizes:
        own = F.when(F.col("_size") == n, _grams(F.col("_s"), n)).otherwise(own)
    own = scratch.keep(parts.select(mark(F.col("_s")).alias("_p"), F.explode(own).alias("_g")).select("_p", mark(F.col("_g")).alias("_g")), "parts")
    # of the holders' grams only those that a part has are written: a gram for each character would be many times the texts
    grams = holders.select(mark(F.col(holder)).alias("_h"), F.explode(F.concat(none, *[_grams(F.col(holder), n) for n in sizes])).alias("_g")).select("_h", mark(F.col("_g")).alias("_g"))
    looked = own.select("_g").distinct()
    looked = F.broadcast(looked) if looked.count() <= BROADCAST_GRAMS else looked
    grams = scratch.keep(grams.join(looked, "_g", "left_semi").select("_h", "_g"), "holders")
    counted = own.join(grams.groupBy("_g").agg(F.count("*").alias("_n")), "_g", "left")
    rarest = counted.groupBy("_p").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_g")).alias("_r")).where("_r._n > 0")
    met = grams.join(rarest.select("_p", F.col("_r._g").alias("_g")), "_g").select("_h", "_p").distinct()
    both = met.join(holders.withColumn("_h", mark(F.col(holder))), "_h").join(held.withColumn("_p", mark(F.col(part))), "_p")
    return both.select(holder, part)


def _held_pairs(holders: DataFrame, holder: str, held: DataFrame, part: str, shortest: int = 1) -> DataFrame:
    """Pairs (holder, part) of distinct strings where the holder contains the part, of `shortest` characters or more."""
    return _met_pairs(holders, holder, held, part, shortest).where(F.contains(F.col(holder), F.col(part)))


def longest_label(texts: DataFrame, text_col: str, labels: DataFrame, shortest: int = 1) -> DataFrame:
    """texts with the id of the longest label (ties: smaller id) that their text holds; null without one. labels: id, label; empty ones match nothing.

    Labels of any length count, unless `shortest` says otherwise. Gram rows hold a hash of the text, not the text; equal texts are looked up once.
    """
    once = texts.select(F.col(text_col).alias("_t")).where("_t is not null").distinct()
    names = labels.groupBy("label").agg(F.min("id").alias("id"))
    best = _held_pairs(once, "_t", names.select("label"), "label", shortest).join(names, "label")
    best = best.groupBy(F.xxhash64("_t").alias("_h"), "_t").agg(F.max_by(F.struct("id", "label"), F.struct(F.length("label"), -F.col("id"))).alias("b"))
    found = texts.withColumn("_h", F.xxhash64(text_col)).join(best, "_h", "left").where(F.col("_t").isNull() | (F.col("_t") == F.col(text_col)))
    return found.select(*texts.columns, F.col("b.id").alias("id"), F.col("b.label").alias("label"))


def repaired_names(items: DataFrame, name_col: str, key: Column, polluted: Column, catalog: DataFrame, shortest: int = 4) -> DataFrame:
    """items with names that are `polluted` (a boolean Column: they read like descriptions) replaced by the catalog's name whose label is the longest that
    the name's key holds; others, and those that hold none, stay. catalog: id, name, label (a key, of `shortest` characters or more). Ties fall to the smaller id."""
    marked = items.withColumn("_key", F.when(F.coalesce(polluted, F.lit(False)), key))
    names = catalog.groupBy("id").agg(F.min("name").alias("_name"))
    found = longest_label(marked, "_key", catalog.where(F.length("label") >= shortest).select("id", "label"), shortest).join(names, "id", "left")
    return found.select(*[F.coalesce("_name", name_col).alias(c) if c == name_col else F.col(c) for c in items.columns])


def expand_groups(items: DataFrame, groups: DataFrame, members: DataFrame, date_col: str = "release_date") -> DataFrame:
    """Items of a group become one row per member; groups: group_id, stem, advertised (0: none), date; members: member_id, name_key, date.

    Members have the group's date and a name that starts with its stem. A group that
    advertises a count other than its number of members isn't expanded; its items stay.
    items: group_id and any other columns; out: those, member_id (null: not expanded).
    """
    pairs = groups.join(members, date_col).where((F.col("stem") != "") & F.startswith("name_key", "stem")).select("group_id", "advertised", "member_id")
    per_group = pairs.groupBy("group_id").agg(F.count("*").alias("n"), F.first("advertised").alias("advertised"))
    valid = per_group.where("advertised = 0 or advertised = n").select("group_id")
    return items.join(pairs.join(valid, "group_id").select("group_id", "member_id"), "group_id", "left")


def first_profile(text: Column, profiles: list[tuple[str, list[str]]]) -> Column:
    """Id of the first profile with a pattern that is found, else null."""
    out = F.lit(None).cast("string")
    for name, patterns in reversed(profiles):
        out = F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)).otherwise(out)
    return out


def unique_match(left: DataFrame, right: DataFrame, key: str, right_id: str) -> DataFrame:
    """left with right_id where exactly one right row has the key, else null."""
    single = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min(right_id).alias(right_id)).where("_n = 1").drop("_n")
    return left.join(single, key, "left")


def first_claim(candidates: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in the given order; rows without a key all stay."""
    first = Window.partitionBy(key).orderBy(*order)
    keyed = candidates.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return keyed.unionByName(candidates.where(F.col(key).isNull()))


def posts_with_accounts(posts: DataFrame, users: DataFrame, accounts: DataFrame) -> DataFrame:
    """Posts with their author (last written row of an id) and the account's entry, by lower-case name; posts of unknown authors stay."""
    latest = users.groupBy("id").agg(F.max_by(F.struct(*[c for c in users.columns if c not in ("id", "ord")]), "ord").alias("u")).select(F.col("id").alias("author_id"), "u.*")
    return posts.join(latest, "author_id", "left").withColumn("_name", F.lower("username")).join(accounts.withColumn("_name", F.lower("username")).drop("username"), "_name", "left").drop("_name")


def fill_start(items: DataFrame, release: Column, context: Column, result: Column, end: Column, policy: Column, resale: str = "再販|再販売|キャンセル分|追加販売") -> Column:
    """A start date from the catalog: the release date, unless resale, before the result or after the end."""
    valid = release.rlike(r"^\d{4}-\d{2}-\d{2}$")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(policy & valid & ~context.rlike(resale) & (empty(result) | (release >= result)) & (empty(end) | (release <= end)), release)
