"""Source registry: defaults, clamps, inference, validation, duplicates, summary, due sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import urls
from harrow.functions.text import non_empty, short_hash

#: The parser names that registries use.
PARSERS = ("generic", "livepocket", "livepocket-search", "google-form", "amiami", "rakuten-books", "hobby-search", "listing-intelligence-v1", "geo-news", "geo-lottery", "hobby-station-news", "furuichi-news")


def bounded(value: Column, default: Column | float, low: float, high: float) -> Column:
    """Number clamped to [low, high]; the default where it is no number."""
    default = default if isinstance(default, Column) else F.lit(default)
    number = value.try_cast("double")
    return F.round(F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(F.nanvl(number, F.lit(None).cast("double")), default.cast("double"))))).cast("int")


def string_array(values: Column) -> Column:
    """Trimmed, without empty ones, the first of equal ones; null is empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != ""))


def default_interval(priority: Column) -> Column:
    return F.when(priority >= 90, 5).when(priority >= 70, 15).when(priority >= 40, 30).otherwise(60)


def platform(explicit: Column, parser: Column, host: Column) -> Column:
    return (
        F.when(non_empty(explicit) != "", explicit)
        .when(parser.startswith("livepocket") | host.endswith("livepocket.jp"), "livepocket")
        .when((parser == "google-form") | host.isin("forms.gle", "docs.google.com", "forms.google.com"), "google_forms")
        .when(host.isin("x.com", "twitter.com"), "x")
        .when(host != "", "website")
        .otherwise("unknown")
    )


def official_status(explicit: Column, official: Column, kind: Column, parser: Column) -> Column:
    return (
        F.when(non_empty(explicit) != "", explicit)
        .when(F.coalesce(official, F.lit(False)), "official")
        .when(F.coalesce((kind == "aggregated") | (parser == "listing-intelligence-v1"), F.lit(False)), "aggregator")
        .otherwise("unverified")
    )


_KNOWN = {"ord", "id", "name", "url", "parser", "enabled", "platform", "official_status", "official", "source_kind", "area", "priority", "interval_minutes", "discovery"}


def normalise(sources: DataFrame, order: str = "ord") -> DataFrame:
    """sources (ord, id, name, url, parser, enabled, platform, official_status, official, source_kind, area, priority,
    interval_minutes, and optionally discovery, a struct) with defaults and clamps, errors and warnings; broken rows and later rows
    of an id are disabled. Other columns are kept as they are."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    host = urls.host(text("url"))
    parser = F.when(text("parser") == "", F.lit("generic")).otherwise(text("parser"))
    named = F.when(text("id") != "", text("id")).otherwise(F.concat(F.lit("source-"), short_hash(text("name"), text("url"), length=12)))
    priority = bounded(F.col("priority"), 70, 0, 100)
    out = sources.select(
        order,
        named.alias("id"),
        F.when(text("name") == "", F.concat(F.lit("Unnamed source "), (F.col(order) + 1).cast("string"))).otherwise(text("name")).alias("name"),
        text("url").alias("url"),
        parser.alias("parser"),
        F.coalesce(F.col("enabled"), F.lit(True)).alias("enabled"),
        platform(text("platform"), parser, host).alias("platform"),
        official_status(text("official_status"), F.col("official"), F.col("source_kind"), parser).alias("official_status"),
        non_empty(text("area"), F.lit("全国")).alias("area"),
        priority.alias("priority"),
        bounded(F.col("interval_minutes"), default_interval(priority), 5, 1440).alias("interval_minutes"),
        (text("id") == "").alias("_generated"),
        host.alias("_host"),
        *([normalise_discovery(parser, F.col("discovery")).alias("discovery")] if "discovery" in sources.columns else []),
        *[c for c in sources.columns if c not in _KNOWN | {order}],
    )
    by_id = Window.partitionBy("id").orderBy(order)
    by_url = Window.partitionBy(F.regexp_replace("url", "/$", "")).orderBy(order)
    checked = out.withColumn("_copy", F.row_number().over(by_id) > 1).withColumn("_same_url", (F.col("url") != "") & (F.row_number().over(by_url) > 1))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    errors = F.array_compact(F.array(flag(F.col("url") == "", "url missing"), flag((F.col("url") != "") & (F.col("_host") == ""), "url invalid"), flag(F.col("_copy"), "id repeated")))
    # a child parser that no registry knows
    child = [flag((F.coalesce("discovery.child_parser", F.lit("")) != "") & ~F.col("discovery.child_parser").isin(*PARSERS), "child parser unknown")] if "discovery" in sources.columns else []
    warnings = F.array_compact(F.array(flag(F.col("_generated"), "id generated"), flag(~F.col("parser").isin(*PARSERS), "parser unknown"), flag(F.col("_same_url"), "url repeated"), *child))
    return checked.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("enabled", F.col("enabled") & (F.size("errors") == 0)).drop("_generated", "_host", "_copy", "_same_url")


def normalise_discovery(parser: Column, d: Column) -> Column:
    """Discovery settings (a struct) with defaults: lists cleaned, include and exclude absent if absent, most pages clamped."""
    search = parser == "livepocket-search"
    kept = lambda c: F.when(d[c].isNotNull(), string_array(d[c]))
    return F.struct(
        F.coalesce(d["enabled"], F.lit(False)).alias("enabled"),
        F.coalesce(d["same_host"], F.lit(True)).alias("same_host"),
        kept("include").alias("include"),
        kept("exclude").alias("exclude"),
        string_array(d["allowed_hosts"]).alias("allowed_hosts"),
        string_array(d["required_path"]).alias("required_path"),
        string_array(d["page_keywords"]).alias("page_keywords"),
        non_empty(F.trim(d["child_parser"]), F.when(search, F.lit("livepocket"))).alias("child_parser"),
        bounded(d["most"].cast("string"), F.when(search, 20).otherwise(8), 1, 100).alias("most"),
    )


def summary(sources: DataFrame, discovery: Column | None = None) -> DataFrame:
    """One row of counts over the registry."""
    on = F.col("enabled")
    return sources.agg(
        F.count("*").alias("total"),
        F.count_if(on).alias("enabled"),
        F.count_if(~on).alias("disabled"),
        F.count_if(on & (F.col("official_status") == "official")).alias("official"),
        F.sum(F.size("warnings")).alias("warnings"),
        F.sum(F.size("errors")).alias("errors"),
    )


def count_by(sources: DataFrame, col: str) -> DataFrame:
    """Enabled sources per value (empty: unknown), in Japanese order of the values."""
    return sources.where("enabled").groupBy(non_empty(F.trim(F.col(col)), F.lit("unknown")).alias(col)).count().orderBy(F.collate(F.col(col), "ja"))


def due(sources: DataFrame, last: Column, interval: Column, now: Column) -> DataFrame:
    """Sources never checked, or last checked at least max(5, interval) minutes ago."""
    wait = F.make_dt_interval(mins=F.greatest(F.lit(5), F.coalesce(interval, F.lit(15))).cast("int"))
    return sources.where(last.isNull() | (now - last >= wait))
