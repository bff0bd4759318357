"""Links of pages: extraction, reason-counted filtering, ranking with caps, relevance."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions import text as tx
from harrow.functions import urls

REASONS = ("invalidUrl", "protocol", "includePattern", "excludePattern", "host", "path")


@dataclass(frozen=True)
class LinkRules:
    """Patterns are case-insensitive regular expressions; one that doesn't compile is a plain substring.
    scores: (weight, patterns, field) with field text or url."""

    include: tuple[str, ...] = ("ポケモンカード", "ポケカ", "抽選")
    exclude: tuple[str, ...] = ("過去", "規約", "faq")
    same_host: bool = True
    allowed_hosts: tuple[str, ...] = ()
    required_path: tuple[str, ...] = ()
    most: int = 8
    scores: tuple[tuple[int, tuple[str, ...], str], ...] = (
        (4, ("抽選", "応募", "エントリー", "受付中", "販売中"), "text"),
        (4, ("ポケモンカード", "ポケカ"), "text"),
        (2, ("/e/", "lottery", "entry", "campaign"), "url"),
    )


def _is_pattern(text: str) -> bool:
    """Whether the JVM, which will run it, takes text for a pattern."""
    jvm = SparkSession.active()._jvm
    try:
        jvm.java.util.regex.Pattern.compile(text)
    except Py4JJavaError:
        return False
    return True


def matches_any(value: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found in value; what is no pattern is a literal."""
    usable = [f"(?:{p})" if _is_pattern(p) else re.escape(p) for p in patterns]
    return value.rlike("(?iu)" + "|".join(usable)) if usable else F.lit(False)


def extract_links(pages: DataFrame, html_col: str = "html", base_col: str | None = None) -> DataFrame:
    """One row per anchor: the page's other columns, ord (from 0), href, link_text and, with a base column, url.

    References with a fragment are no links. Relative ones are resolved in Python, in batches;
    absolute ones stay in the JVM.
    """
    pattern = F.lit(r"""(?is)<a\b[^>]*href=["']([^"'#]+)["'][^>]*>(.*?)</a>""")
    html = F.coalesce(F.col(html_col), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(html, pattern, 1).alias("href"), F.regexp_extract_all(html, pattern, 2).alias("body"))
    rest = [c for c in pages.columns if c != html_col]
    found = pages.select(*rest, F.posexplode(pairs).alias("ord", "a"))
    links = found.select(*rest, "ord", tx.decode_entities(F.col("a.href")).alias("href"), tx.html_to_text(F.col("a.body")).alias("link_text"))
    if base_col is None:
        return links
    absolute, rooted = F.col("href").rlike("(?i)^https?://"), F.col("href").rlike("^/(?!/)")
    site = F.regexp_extract(F.col(base_col), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return links.withColumn(
        "url", F.when(absolute, F.col("href")).when(rooted & (site != ""), F.concat(site, F.col("href"))).otherwise(urls.resolve_url(F.col("href"), F.col(base_col)))
    )


def link_reason(url: Column, text: Column, source_host: Column, rules: LinkRules, trusted: Column | None = None) -> Column:
    """The first rule that rejects the link, or null. Trusted links skip patterns and paths."""
    trusted = F.lit(False) if trusted is None else trusted
    scheme, host = urls.url_part(url, "scheme"), urls.host(url)
    haystack = F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(url, F.lit("")))
    wrong_host = (host != source_host) if rules.same_host else (~urls.host_under(host, list(rules.allowed_hosts)) if rules.allowed_hosts else F.lit(False))
    path = F.concat(urls.url_part(url, "path"), urls.url_part(url, "query"))
    named = F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return (
        F.when((named == "") | (F.lower(named).isin("http", "https") & (host == "")), F.lit("invalidUrl"))
        .when(~F.lower(named).isin("http", "https"), F.lit("protocol"))
        .when(~trusted & ~matches_any(haystack, rules.include), F.lit("includePattern"))
        .when(~trusted & matches_any(haystack, rules.exclude), F.lit("excludePattern"))
        .when(wrong_host, F.lit("host"))
        .when(~trusted & (~matches_any(path, rules.required_path) if rules.required_path else F.lit(False)), F.lit("path"))
    )


def link_score(url: Column, text: Column, rules: LinkRules) -> Column:
    total = F.lit(0)
    for weight, patterns, field in rules.scores:
        total = total + F.when(matches_any(text if field == "text" else url, patterns), F.lit(weight)).otherwise(F.lit(0))
    return total


def judge_links(links: DataFrame, rules: LinkRules, source_col: str, host_col: str) -> DataFrame:
    """links with reason (null: accepted), canonical_url, score, and fate: rejected, duplicate, truncated or returned.

    Within a source accepted links go by score, then order; the first of an address stays, then the cap.
    """
    judged = (
        links.withColumn("reason", link_reason(F.col("url"), F.col("link_text"), F.col(host_col), rules))
        .withColumn("canonical_url", F.when(F.col("reason").isNull(), urls.canonical_url(F.col("url"), urls.CANDIDATE)))
        .withColumn("score", F.when(F.col("reason").isNull(), link_score(F.col("url"), F.col("link_text"), rules)))
    )
    order = [F.desc("score"), F.asc("ord")]
    same = Window.partitionBy(source_col, "canonical_url").orderBy(*order)
    firsts = judged.withColumn("_copy", F.when(F.col("reason").isNull(), F.row_number().over(same)))
    within = Window.partitionBy(source_col, F.col("_copy") == 1).orderBy(*order)
    return firsts.withColumn("rank", F.when(F.col("_copy") == 1, F.row_number().over(within))).withColumn(
        "fate",
        F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_copy") > 1, "duplicate").when(F.col("rank") > rules.most, "truncated").otherwise("returned"),
    ).drop("_copy")


def discovery_stats(judged: DataFrame, source_col: str) -> DataFrame:
    """Per source: links, accepted, returned, duplicates, truncated, and a count for each reason. accepted = returned + duplicates + truncated."""
    count = lambda cond, name: F.count_if(cond).alias(name)
    return judged.groupBy(source_col).agg(
        F.count("*").alias("total_links"),
        count(F.col("reason").isNull(), "accepted"),
        count(F.col("fate") == "returned", "returned"),
        count(F.col("fate") == "duplicate", "duplicates"),
        count(F.col("fate") == "truncated", "truncated"),
        *[count(F.coalesce(F.col("reason") == r, F.lit(False)), f"rejected_{r}") for r in REASONS],
    )


@dataclass(frozen=True)
class Bound:
    """Links of one kind of source that are taken by where they lead and by the text around them. parser: the sources' layout. hosts: where links may lead.
    where: pattern of path and query, "" for any. near: patterns that the link's text with the text around (before, after: characters of HTML) must hold.
    child: the layout of the page behind the link."""

    parser: str
    hosts: tuple[str, ...]
    where: str
    near: tuple[str, ...]
    child: str
    before: int = 1200
    after: int = 800


#: The kinds of sources whose links are taken so.
BOUND = (
    Bound("hobby-station-news", ("hbst.net",), r"(?i)[?&]p(?:=|&|$)|/(?:news|blog)/", (), "hobby-station-news"),
    Bound("hobby-station-news", ("livepocket.jp",), "", ("(?i)ポケモンカード|ポケカ", "(?i)抽選|応募|LivePocket|ライブポケット"), "livepocket"),
    Bound("furuichi-news", ("furu1.net",), "(?i)/news/(?:news_information|news_campaign)/", ("(?i)ポケモンカード|ポケカ", "抽選|受付"), "furuichi-news", 600, 600),
)


def bound_links(pages: DataFrame, bounds: tuple[Bound, ...] = BOUND, parser_col: str = "parser", html_col: str = "html", base_col: str = "base") -> DataFrame:
    """Links of pages whose source has a Bound: the pages' other columns, ord, url (without fragment), link_text (with the text around), child, trusted (true).

    The first place of an address on a page counts. Addresses are absolute or from the host's root; others and those of other sources have no row. What is trusted
    skips the patterns and paths of link_reason.
    """
    rest = [c for c in pages.columns if c != html_col]
    own = pages.where(F.col(parser_col).isin(*{b.parser for b in bounds})).withColumn("_h", tx.decode_entities(F.coalesce(F.col(html_col), F.lit(""))))
    parts = F.split("_h", r"(?i)(?=<a\b[^>]*href\s*=)")
    run = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(parts, run, lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
    tag = r"""(?is)^<a\b[^>]*href\s*=\s*(["'])(.*?)\1[^>]*>(.*?)</a>"""
    found = F.transform(F.arrays_zip(parts.alias("part"), starts.alias("at")), lambda p, i: F.struct(i.alias("ord"), p["at"].alias("at"), F.regexp_extract(p["part"], tag, 0).alias("tag")))
    anchors = own.select(*rest, "_h", F.explode(F.filter(found, lambda p: p["tag"] != "")).alias("_p"))
    anchors = anchors.select(*rest, "_h", "_p.ord", F.regexp_extract("_p.tag", tag, 2).alias("_href"), F.regexp_extract("_p.tag", tag, 3).alias("_body"), F.length("_p.tag").alias("_size"), F.col("_p.at").alias("_at"))
    site = F.regexp_extract(F.col(base_col), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    whole = F.when(F.col("_href").rlike("(?i)^https?://"), F.col("_href")).when(F.col("_href").rlike("^/(?!/)"), F.concat(site, F.col("_href")))
    anchors = anchors.withColumn("url", F.regexp_replace(whole, "#.*$", "")).where("url is not null")
    path = F.concat(urls.url_part(F.col("url"), "path"), urls.url_part(F.col("url"), "query"))
    text = lambda b: F.trim(F.regexp_replace(F.concat_ws(" ", tx.html_to_text(F.col("_body")), tx.html_to_text(F.substring("_h", F.greatest(F.col("_at") - b.before, F.lit(0)) + 1, F.least(F.col("_at"), F.lit(b.before)) + F.col("_size") + b.after))), r"(?U)\s+", " "))
    anchors = anchors.withColumns({"_host": urls.host(F.col("url")), "_path": path})
    # the text around is read once, and only for links that lead where the Bound says; an explode, as a filter behind it would have it read again
    def near(n: int, b: Bound) -> Callable[[Column], Column]:
        def read(t: Column) -> Column:
            hit = F.lit(True)
            for pattern in b.near:
                hit = hit & t.rlike(pattern)
            return F.when(hit, F.struct(F.lit(n).alias("n"), F.lit(b.child).alias("child"), t.alias("text")))

        return read

    choices, told = [], None
    for n, b in enumerate(bounds):
        leads = (F.col(parser_col) == b.parser) & urls.host_under(F.col("_host"), list(b.hosts)) & (F.col("_path").rlike(b.where) if b.where else F.lit(True))
        choices.append(F.when(leads, tx.let(text(b) if b.near else F.lit(None).cast("string"), near(n, b))))
        plain = text(b) if not b.near else F.col("_c.text")
        told = F.when(F.col("_c.n") == n, plain) if told is None else told.when(F.col("_c.n") == n, plain)
    kept = anchors.withColumn("_c", F.explode(F.array_compact(F.array(F.coalesce(*choices)))))
    kept = kept.select(*rest, "ord", "url", told.alias("link_text"), F.col("_c.child").alias("child"))
    first = Window.partitionBy(*[c for c in rest if c == base_col or c == parser_col or c.endswith("_id")], "url").orderBy("ord")
    kept = kept.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select(*rest, "ord", "url", "link_text", "child", F.lit(True).alias("trusted"))


def merge_links(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Links of two extractors by key: the first's text unless empty, then the second's; flags joined."""
    a = first.select(*key, F.col("link_text").alias("_a"), F.lit(True).alias("in_first"))
    b = second.select(*key, F.col("link_text").alias("_b"), F.lit(True).alias("in_second"))
    both = a.join(b, key, "full_outer")
    return both.select(*key, tx.non_empty(tx.js_trim(F.col("_a")), tx.js_trim(F.col("_b"))).alias("link_text"), F.coalesce("in_first", F.lit(False)).alias("in_first"), F.coalesce("in_second", F.lit(False)).alias("in_second"))


def context_links(pages: DataFrame, pattern: str, before: int, after: int, html_col: str = "html") -> DataFrame:
    """Addresses found anywhere in the raw page, embedded data too, each place with the text around it: rest, ord, url, context.

    `pattern` has no groups. Places come from one pass that adds up the lengths between them.
    """
    rest = [c for c in pages.columns if c != html_col]
    pages = pages.withColumn("_h", F.replace(F.replace(F.coalesce(F.col(html_col), F.lit("")), F.lit("\\/"), F.lit("/")), F.lit("&amp;"), F.lit("&")))
    parts = F.split("_h", f"(?={pattern})")
    run = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(parts, run, lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
    found = pages.select(*rest, "_h", F.posexplode(F.arrays_zip(parts.alias("part"), starts.alias("at"))).alias("ord", "_p"))
    found = found.withColumn("url", F.regexp_extract("_p.part", f"^({pattern})", 1)).where("url != ''")
    start = F.greatest(F.col("_p.at") - before, F.lit(0))
    around = F.substring("_h", start + 1, F.col("_p.at") - start + F.length("url") + after)
    return found.select(*rest, "ord", "url", tx.html_to_text(around).alias("context"))


def looks_relevant(html: Column, keywords: list[str] | None = None, both: tuple[str, str] = ("ポケモンカード|ポケカ", "抽選|応募|エントリー")) -> Column:
    """Whether a page holds any keyword; without keywords, both patterns."""
    text = tx.html_to_text(html)
    if keywords:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | text.contains(k)
        return hit
    return text.rlike("(?i)" + both[0]) & text.rlike("(?i)" + both[1])
