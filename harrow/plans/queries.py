"""Registered queries: each operator of the library on the tables that stand in for its inputs, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions import text as tx
from harrow.functions import urls
from harrow.operators import discover, gate, health, match, merge, parse, places, products, rank, registry, state
from harrow.scratch import Scratch
from harrow.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "timestamp'2001-08-01 00:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- pieces of SQL that several oracles share


def _rx(value: str, *rules: tuple[str, str]) -> str:
    for pattern, by in rules:
        p = pattern.replace("'", "''")
        value = f"regexp_replace({value}, '{p}', {by}, 'g')"
    return value


def _sql_entities(value: str) -> str:
    return _rx(value, ("(?i)&lt;", "'<'"), ("(?i)&gt;", "'>'"), ("(?i)&quot;", "'\"'"), ("(?i)&apos;", "''''"), ("(?i)&nbsp;", "' '"), ("(?i)&amp;", "'&'"))


def _sql_text(value: str) -> str:
    value = f"coalesce({value}, '')"
    for tag in ("script", "style", "noscript"):
        value = _rx(value, (rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "chr(10)"))
    value = _rx(value, (r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</(?:p|div|li|section|article|h[1-6]|tr)>", "chr(10)"), ("<[^>]+>", "' '"))
    value = _rx(_sql_entities(value), ("\r", "''"), ("[ \t]+", "' '"), ("\n[ \t]+", "chr(10)"), ("\n{3,}", "chr(10)||chr(10)"))
    return _rx(value, (r"^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$", "''"))


_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def _sql_part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{_URL}', {group})"


def _sql_host(url: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({_sql_part(url, 2)}), ':\d+$', ''), '^www\.', '')"


def _sql_canonical(url: str, drop: str, strip: bool) -> str:
    kept = f"array_to_string(list_filter(string_split(substr({_sql_part(url, 4)}, 2), '&'), lambda p: p <> '' and not regexp_matches(lower(regexp_extract(p, '^([^=]*)', 1)), '^{drop}')), '&')"
    path = f"case when {_sql_part(url, 3)} = '' then '/' else {_sql_part(url, 3)} end"
    whole = f"lower({_sql_part(url, 1)}) || '://' || lower({_sql_part(url, 2)}) || {path} || case when {kept} <> '' then '?' || {kept} else '' end"
    whole = f"regexp_replace({whole}, '/$', '')" if strip else whole
    return f"case when {_sql_part(url, 2)} <> '' then {whole} else trim({url}) end"


_LINK_PATTERN = r"""(?is)<a\b[^>]*href=["'']([^"''#]+)["''][^>]*>(.*?)</a>"""
_SQL_LINKS = f"""
    raw as (select page_id, url as base, regexp_extract_all(html, '{_LINK_PATTERN}', 1) as hrefs, regexp_extract_all(html, '{_LINK_PATTERN}', 2) as bodies from pages),
    each as (select page_id, base, hrefs, bodies, unnest(range(1, len(hrefs) + 1)) as i from raw),
    links as (select page_id, base, i - 1 as ord, {_sql_entities("hrefs[i]")} as href, {_sql_text("bodies[i]")} as link_text from each),
    absolute as (select *, case when regexp_matches(href, '(?i)^https?://') then href else regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || href end as url from links)"""

RULES = discover.LinkRules(include=("th", "e[rn]"), exclude=("edly", "ing$"), required_path=("/[a-zé]{2,}",), most=4, scores=((4, ("er", "on"), "text"), (4, ("the",), "text"), (2, ("/t", "an"), "url")))
_SQL_JUDGED = f"""with {_SQL_LINKS},
    judged as (select page_id, ord, link_text, url,
        case when {_sql_part("url", 2)} = '' then 'invalidUrl'
             when lower({_sql_part("url", 1)}) not in ('http', 'https') then 'protocol'
             when not regexp_matches(link_text || ' ' || url, '(?i)(?:th)|(?:e[rn])') then 'includePattern'
             when regexp_matches(link_text || ' ' || url, '(?i)(?:edly)|(?:ing$)') then 'excludePattern'
             when {_sql_host("url")} <> {_sql_host("base")} then 'host'
             when not regexp_matches({_sql_part("url", 3)} || {_sql_part("url", 4)}, '(?i)(?:/[a-zé]{{2,}})') then 'path' end as reason,
        lower({_sql_part("url", 1)}) || '://' || lower({_sql_part("url", 2)}) || {_sql_part("url", 3)} || {_sql_part("url", 4)} as canon,
        (case when regexp_matches(link_text, '(?i)(?:er)|(?:on)') then 4 else 0 end) + (case when regexp_matches(link_text, '(?i)(?:the)') then 4 else 0 end)
          + (case when regexp_matches(url, '(?i)(?:/t)|(?:an)') then 2 else 0 end) as points from absolute),
    copies as (select *, case when reason is null then row_number() over (partition by page_id, canon, reason is null order by points desc, ord) end as copy from judged),
    ranked as (select *, case when copy = 1 then row_number() over (partition by page_id, copy = 1 order by points desc, ord) end as rank from copies),
    fated as (select *, case when reason is not null then 'rejected' when copy > 1 then 'duplicate' when rank > 4 then 'truncated' else 'returned' end as fate from ranked)"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("base"), urls.host(F.col("url")).alias("host"), "html")
    return discover.judge_links(discover.extract_links(pages, base_col="base"), RULES, "page_id", "host")


# ---- pages: text, links, addresses


@query(f"select page_id, sha256(t) as text_sha256, length(t) as n_chars from (select page_id, {_sql_text('html')} as t from pages)")
def html_to_text(spark, sf):
    text = table(spark, sf, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("t"))
    return text.select("page_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("long").alias("n_chars"))


@query(f"with {_SQL_LINKS} select page_id, ord::int as ord, href, link_text, url from absolute")
def page_links(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("base"), "html")
    return discover.extract_links(pages, base_col="base").select("page_id", "ord", "href", "link_text", "url")


@query(_SQL_JUDGED + " select page_id, ord::int as ord, url, reason, fate from fated")
def link_waterfall(spark, sf):
    return _judged(spark, sf).select("page_id", "ord", "url", "reason", "fate")


@query(_SQL_JUDGED + " select page_id, rank::int as rank, canon as canonical_url, points::int as score from fated where fate = 'returned'")
def link_topk(spark, sf):
    return _judged(spark, sf).where("fate = 'returned'").select("page_id", "rank", "canonical_url", "score")


@query(
    _SQL_JUDGED
    + """ select page_id, count(*) as total_links, count(*) filter (reason is null) as accepted, count(*) filter (fate = 'returned') as returned, count(*) filter (fate = 'duplicate') as duplicates,
    count(*) filter (fate = 'truncated') as truncated, """
    + ", ".join(f"count(*) filter (reason = '{r}') as \"rejected_{r}\"" for r in discover.REASONS)
    + " from fated group by page_id"
)
def discovery_stats(spark, sf):
    return discover.discovery_stats(_judged(spark, sf), "page_id")


@query(
    f"""with {_SQL_LINKS}, a as (select page_id, url, min(link_text) as link_text from absolute group by all), b as (select page_id, url, max(link_text) as link_text from absolute where ord % 2 = 0 group by all)
    select page_id, url, case when coalesce(a.link_text, '') <> '' then a.link_text else coalesce(b.link_text, '') end as link_text, a.url is not null as in_first, b.url is not null as in_second
    from a full outer join b using (page_id, url)"""
)
def link_union(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("base"), "html")
    links = discover.extract_links(pages, base_col="base")
    a = links.groupBy("page_id", "url").agg(F.min("link_text").alias("link_text"))
    b = links.where("ord % 2 = 0").groupBy("page_id", "url").agg(F.max("link_text").alias("link_text"))
    return discover.merge_links(a, b, ["page_id", "url"])


@query(
    f"""select page_id, {_sql_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title,
    regexp_matches({_sql_text("html")}, '(?i)the') and regexp_matches({_sql_text("html")}, '(?i)ion') as relevant from pages"""
)
def page_relevance(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.tag_text(F.col("html"), "title").alias("title"), discover.looks_relevant(F.col("html"), both=("the", "ion")).alias("relevant"))


@query(f"select page_id, {_sql_canonical('url', '(?:utm_|fbclid|gclid|yclid|_ga|ref$)', True)} as scope_url, {_sql_host('url')} as host from pages")
def url_canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url"), urls.SCOPE).alias("scope_url"), urls.host(F.col("url")).alias("host"))


@query(f"select page_id, substr(sha256({_sql_canonical('url', '(?:utm_|fbclid$|gclid$|yclid$|ref$|source$)', False)}), 1, 24) as opaque_key from pages")
def url_opaque_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.opaque_key(F.col("url")).alias("opaque_key"))


@query(
    f"""select k as canonical_url, count(*) as n_pages, min(page_id) as first_page from (select page_id, {_sql_canonical('url', '(?:utm_|ref$|source$|from$|fbclid$|gclid$)', True)} as k from pages) group by k"""
)
def url_dup_groups(spark, sf):
    keyed = table(spark, sf, "pages").select("page_id", urls.identity_url(F.col("url")).alias("canonical_url"))
    return keyed.groupBy("canonical_url").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@query(f"select h as host, count(*) as n_pages, count(*) filter (url like 'https:%') as n_https, sum(length(html))::bigint as n_chars from (select *, {_sql_host('url')} as h from pages) group by h")
def host_rollup(spark, sf):
    pages = table(spark, sf, "pages").withColumn("host", urls.host(F.col("url")))
    return pages.groupBy("host").agg(F.count("*").alias("n_pages"), F.count_if(F.col("url").startswith("https:")).alias("n_https"), F.sum(F.length("html")).cast("long").alias("n_chars"))


@query(f"select page_id, case when {_sql_host('url')} = 'spam-farm.example.org' or ends_with({_sql_host('url')}, '.example.net') then '' else url end as url from pages")
def blocked_hosts(spark, sf):
    pages = table(spark, sf, "pages")
    blocked = urls.host_under(urls.host(F.col("url")), ["spam-farm.example.org", "example.net"])
    return pages.select("page_id", F.when(blocked, "").otherwise(F.col("url")).alias("url"))


@query("select page_id, case when regexp_matches(regexp_extract(lower(url), '://([^/?#]+)', 1), 'x\\.com$|twitter\\.com$|example\\.com$') then '' else url end as url, length(html) as n_chars from pages")
def privacy_projection(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url", F.length("html").cast("long").alias("n_chars"), F.lit("crawler").alias("sourceType"), F.lit("feed").alias("sourceUrl"))
    shown = gate.public_projection(rows, notice_col=None)
    return shown.withColumn("url", F.when(urls.url_part(F.col("url"), "host").rlike(r"example\.com$"), "").otherwise(F.col("url")))


# ---- documents: fingerprints, first wins, lines, matches, evidence


@query(
    rf"""select doc_id, sha256(left({_rx("regexp_replace(regexp_replace(" + _sql_text("text") + r", '(?i)\b(?:csrf|nonce|token)[-_:=\s\"'']+[a-z0-9_-]{12,}\b', ' ', 'g'), '(?i)\b[a-f0-9]{32,64}\b', ' ', 'g')", (r"\s+", "' '"), (r"^\s+|\s+$", "''"))}, 500000)) as fingerprint from documents"""
)
def doc_fingerprint(spark, sf):
    return tx.with_fingerprint(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "fingerprint")


@query("select min(doc_id) as doc_id, count(*) as copies from (select *, coalesce(text, '') as t from documents) group by t")
def doc_first_wins(spark, sf):
    docs = table(spark, sf, "documents").withColumn("k", F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("select doc_id, lang, source from (select *, row_number() over (partition by lang, source order by n_chars desc, doc_id) as r from documents) where r = 1")
def first_by_key(spark, sf):
    return merge.first_wins(table(spark, sf, "documents"), ["lang", "source"], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "lang", "source")


@query(r"select doc_id, len(l) as n_lines, len(list_distinct(list_transform(l, lambda s: lower(regexp_replace(s, '\s+', '', 'g'))))) as n_distinct from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(regexp_replace(s, '^[\s・●■◆◇※]+', ''), '^\s+|\s+$', '', 'g')), lambda s: s <> '') as l from documents)")
def line_dedupe(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", tx.lines_of(F.col("text")).alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(tx.distinct_lines(F.col("l"))).cast("long").alias("n_distinct"))


@query(
    """select doc_id, i as chunk, sha256(substr(text, i * 980 + 1, 1200)) as chunk_sha256 from (select doc_id, text, unnest(range(0, greatest(ceil((length(text) - 220) / 980.0), 1)::bigint)) as i from documents where length(text) > 1400)
    union all select doc_id, 0, sha256(text) from documents where length(text) <= 1400"""
)
def overlapping_chunks(spark, sf):
    cut = table(spark, sf, "documents").select("doc_id", F.posexplode(tx.overlapping_chunks(F.col("text"))).alias("chunk", "t"))
    return cut.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.sha2("t", 256).alias("chunk_sha256"))


@query(
    """with l as (select doc_id, string_split(text, chr(10)) as l from documents), w as (select doc_id, unnest(range(1, len(l) + 1)) as i, l from l)
    select doc_id, (i - 1)::int as line, sha256(array_to_string(l[greatest(i - 2, 1):i + 7], chr(10))) as window_sha256 from w where regexp_matches(array_to_string(l[greatest(i - 2, 1):i + 7], chr(10)), 'Licensed|License')"""
)
def line_window(spark, sf):
    lines = table(spark, sf, "documents").where(F.col("text").rlike("Licensed|License")).select("doc_id", F.split("text", "\n").alias("l"))
    windows = lines.select("doc_id", F.posexplode(tx.line_windows(F.col("l"), 2, 8)).alias("line", "w"))
    return windows.where(F.col("w").rlike("Licensed|License")).select("doc_id", "line", F.sha2("w", 256).alias("window_sha256"))


_SQL_NORM = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


@query(
    f"""with v as (select distinct {_SQL_NORM("p_type || ' ' || p_name")} as t from part), k as (select p_partkey as id, {_SQL_NORM("p_name")} as k from part),
    s as (select t, id, k, case when t = k then 10000 + length(k) when length(k) >= 4 and contains(t, k) then 2000 + length(k) - 2 * abs(length(t) - length(k)) when length(t) >= 4 and contains(k, t) then 1000 + length(t) - 3 * abs(length(t) - length(k)) end as score from v, k where length(t) >= 3)
    select t as value, id, k as label, score::int as score from (select *, row_number() over (partition by t order by score desc, id) as r from s where score is not null) where r = 1"""
)
def best_match(spark, sf):
    part = table(spark, sf, "part")
    norm = lambda c: tx.normalised(c, keep="a-z0-9")
    values = part.select(norm(F.concat_ws(" ", "p_type", "p_name")).alias("value")).distinct().withColumn("t", F.col("value"))
    keys = part.select(F.col("p_partkey").alias("id"), F.lit(0).alias("ordinal"), norm(F.col("p_name")).alias("key"))
    return match.best_match(values, "t", keys, row_cols=["value"])


@query(
    """select doc_id, id, label from (select d.doc_id, b.item_id as id, b.text as label, row_number() over (partition by d.doc_id order by length(b.text) desc, b.item_id) as r
    from documents d left join benchmark b on contains(d.text, b.text)) where r = 1"""
)
def longest_label(spark, sf):
    labels = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("label"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # every text holds the empty label, which lookups leave out
    empty = labels.agg(F.min(F.when(F.col("label") == "", F.col("id"))).alias("_empty"))
    found = places.best_label(docs, "text", labels).crossJoin(F.broadcast(empty))
    only = F.col("id").isNull() & F.col("text").isNotNull() & F.col("_empty").isNotNull()
    return found.select("doc_id", F.when(only, F.col("_empty")).otherwise(F.col("id")).alias("id"), F.when(only, "").otherwise(F.col("label")).alias("label"))


@query(
    """with g as (select p_brand as group_id, p_type as release_date, lower(substr(p_name, 1, 3)) as stem, count(*) as n from part group by all),
    groups as (select group_id, release_date, min(stem) as stem, 0 as advertised from g group by all),
    pairs as (select group_id, release_date, p_partkey as member_id from groups join part on p_type = release_date where starts_with(lower(p_name), stem))
    select group_id, release_date, member_id from groups left join pairs using (group_id, release_date)"""
)
def group_expand(spark, sf):
    part = table(spark, sf, "part")
    groups = part.groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("release_date")).agg(F.min(F.lower(F.substring("p_name", 1, 3))).alias("stem"))
    groups = groups.withColumn("group_id", F.concat_ws("|", "brand", "release_date"))
    members = part.select(F.col("p_partkey").alias("member_id"), F.lower("p_name").alias("name_key"), F.col("p_type").alias("release_date"))
    items = groups.select("group_id", F.col("brand"), F.col("release_date").alias("date"))
    out = match.expand_groups(items, groups.select("group_id", "stem", "release_date", F.lit(0).alias("advertised")), members)
    return out.select(F.col("brand").alias("group_id"), F.col("date").alias("release_date"), "member_id")


@query(
    """with recursive ordered as (select source || '|' || lang as k, d.doc_id, case when l.quality = 1 then 0.9::double else 0.5::double end as c, case when d.n_chars > 1500 then 0.15::double else 0.0::double end as b, l.toxic as kind,
        row_number() over (partition by source || '|' || lang order by d.doc_id) as n from documents d join labels l on d.doc_id = l.doc_id),
    fold as (select k, n, c, b, doc_id, [kind] as kinds, 1::bigint as evidence from ordered where n = 1
        union all select f.k, o.n, round(least(0.99::double, greatest(f.c, o.c) + 0.04::double), 2), case when o.c + o.b > f.c + f.b then o.b else f.b end, case when o.c + o.b > f.c + f.b then o.doc_id else f.doc_id end,
            case when list_contains(f.kinds, o.kind) then f.kinds else list_append(f.kinds, o.kind) end, f.evidence + 1 from fold f join ordered o on o.k = f.k and o.n = f.n + 1)
    select k as key, doc_id, len(kinds) as n_kinds, evidence, round(c, 2) as confidence from (select *, row_number() over (partition by k order by n desc) as r from fold) where r = 1"""
)
def evidence_merge(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.concat_ws("|", "source", "lang").alias("key"), "doc_id", F.when(F.col("quality") == 1, 0.9).otherwise(0.5).alias("confidence"), "toxic", F.when(F.col("n_chars") > 1500, 0.15).otherwise(0.0).alias("bonus")
    )
    merged = merge.merge_evidence(rows.withColumn("ord", F.col("doc_id")), "key", ["ord"], F.col("bonus"), "toxic", "confidence", ["doc_id"])
    return merged.select("key", "doc_id", F.size("kinds").cast("long").alias("n_kinds"), "evidence", F.round("confidence", 2).alias("confidence"))


@query(
    """select d.lang, count(*) as total, count(*) filter (l.doc_id is not null) as present, round(100.0 * count(*) filter (l.doc_id is not null) / count(*), 1) as percent from documents d left join labels l on d.doc_id = l.doc_id group by d.lang"""
)
def label_coverage(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    return health.coverage(rows, F.col("has").isNotNull(), ["lang"])


@query(
    """select source as key, count(*) as replies, count(*) filter (toxic = 0) as accepting, count(*) filter (toxic = 0) >= ceil(count(*) / 2.0) as accepted, round(avg(case when toxic = 0 then 0.5 + 0.4 * quality end), 4) as confidence
    from documents d join labels l on d.doc_id = l.doc_id group by source"""
)
def vote(spark, sf):
    replies = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("source").alias("key"), (F.col("toxic") == 0).alias("accepted"), (F.lit(0.5) + 0.4 * F.col("quality")).alias("confidence"), F.lit(True).alias("ok")
    )
    return health.vote(replies, "key", "accepted", "confidence", "ok")


@query(
    """select key, checked, ok, failed, warnings, errors, items, empty, case when errors > 0 or failed = checked then 'partial' when failed > 0 then 'degraded' else 'ok' end as status, case when errors > 0 then 'error' when warnings > 0 then 'warning' else 'ok' end as level
    from (select source as key, count(*) as checked, count(*) filter (n_chars >= 200) as ok, count(*) filter (n_chars < 200) as failed, count(*) filter (n_chars < 200 and n_chars >= 60) as warnings, count(*) filter (n_chars < 60) as errors,
        sum((n_chars / 1000)::bigint)::bigint as items, count(*) filter (n_chars >= 200 and (n_chars / 1000)::bigint = 0) as empty from (select source, n_chars, 0 from documents) group by source)""".replace("(n_chars / 1000)::bigint", "(n_chars // 1000)")
)
def health_rollup(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("key"), "n_chars", F.floor(F.col("n_chars") / 1000).alias("items"))
    severity = F.when(F.col("n_chars") < 60, "error").otherwise("warning")
    rolled = health.roll_up(rows, ["key"], F.col("n_chars") >= 200, "items", severity)
    return rolled.withColumn("status", health.run_status(F.col("failed"), F.col("errors"), F.col("checked"))).withColumn("level", health.report_level(F.col("errors"), F.col("warnings"))["level"])


# ---- orders: scopes, revisits, upserts, gate


@query(
    """with prev as (select * from orders where o_orderdate < timestamp '1999-01-01'), cur as (select * from orders where o_orderdate >= timestamp '1999-01-01')
    select o_orderkey, o_custkey from prev where o_custkey % 7 = 0 or o_custkey not in (select o_custkey from cur where o_custkey % 7 <> 0)"""
)
def scope_replace(spark, sf):
    scope = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("string")).otherwise("")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", scope.alias("scope"))
    cut = F.lit("1999-01-01").cast("timestamp")
    return merge.replace_scopes(orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut), "scope").select("o_orderkey", "o_custkey")


@query(
    """with seen as (select distinct o_custkey, o_orderstatus || o_orderpriority as u from orders where o_orderdate >= timestamp '2000-06-01'),
    prev as (select o_custkey, o_orderstatus || o_orderpriority as u, o_orderdate, o_orderkey from orders where o_orderdate < timestamp '2000-06-01'),
    once as (select * from (select p.*, row_number() over (partition by p.o_custkey, p.u order by o_orderdate desc, o_orderkey) as r from prev p left join seen s on p.o_custkey = s.o_custkey and p.u = s.u where s.u is null) where r = 1)
    select o_custkey, u as url, o_orderkey, rank::int as rank from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rank from once) where rank <= 6"""
)
def revisit_topk(spark, sf):
    orders = table(spark, sf, "orders").withColumn("url", F.concat("o_orderstatus", "o_orderpriority"))
    cut = F.lit("2000-06-01").cast("timestamp")
    return merge.revisit(orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut), "o_custkey", "url", "o_orderdate", 6, "o_orderkey").select("o_custkey", "url", "o_orderkey", "rank")


@query(
    """with now as (select distinct o_custkey from orders where o_orderdate >= timestamp '1999-01-01') select c_custkey, c_mktsegment from customer left join now on c_custkey = o_custkey
    where not (c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey % 2 = 0 and o_custkey is null)"""
)
def prune_missing(spark, sf):
    now = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp")).select(F.col("o_custkey").cast("string").alias("key"))
    rows = table(spark, sf, "customer").withColumn("key", F.col("c_custkey").cast("string"))
    kept = merge.prune_missing(rows, now, "key", F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_nationkey") % 2 == 0)
    return kept.select("c_custkey", "c_mktsegment")


@query(
    """with old as (select c_custkey as k, c_mktsegment as seg, c_acctbal as bal from customer where c_custkey % 3 <> 0), new as (select c_custkey as k, case when c_custkey % 5 = 0 then '' else lower(c_mktsegment) end as seg, case when c_custkey % 4 = 0 then null else c_acctbal + 1 end as bal, c_acctbal > 0 as complete from customer where c_custkey % 2 = 0)
    select coalesce(old.k, new.k) as k, coalesce(nullif(new.seg, ''), old.seg) as seg, round(coalesce(new.bal, old.bal), 4) as bal, case when new.k is null then 'keep' when old.k is not null then 'update' when complete then 'insert' else 'review' end as status from old full outer join new on old.k = new.k"""
)
def catalog_upsert(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    new = c.where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.lower("c_mktsegment")).alias("seg"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") + 1).alias("bal"), (F.col("c_acctbal") > 0).alias("complete")
    )
    return merge.upsert(old, new, "k", F.col("complete")).withColumn("bal", F.round("bal", 4))


@query(
    """select o_custkey, max_by(o_orderkey, struct_pack(s := strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o := o_orderkey)) as o_orderkey, min_by(o_orderdate, struct_pack(s := strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o := o_orderkey)) as created, count(*) as versions from orders group by o_custkey"""
)
def latest_wins(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.col("o_orderdate").alias("created"))
    return merge.latest_wins(orders, "o_custkey", ["stamp"], "o_orderkey", "created").select("o_custkey", "o_orderkey", "created", "versions")


@query(
    """select o_custkey, max(case when o_orderstatus <> 'P' then [o_orderkey::varchar, o_orderstatus] end)[2] as last_status, count(*) as n from orders where false group by o_custkey
    union all select o_custkey, max_by(o_orderstatus, o_orderkey), count(distinct o_orderpriority) from orders group by o_custkey"""
)
def candidate_merge(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.array("o_orderpriority").alias("aliases"), "o_totalprice")
    merged = merge.merge_products(rows, "o_custkey", "o_orderkey", [], ["o_orderstatus"], "aliases", "o_totalprice")
    return merged.select("o_custkey", F.col("o_orderstatus").alias("last_status"), F.size("aliases").cast("long").alias("n"))


@query(
    """with t as (select c_custkey as k, c_acctbal as at from customer where c_custkey % 11 = 0), live as (select distinct o_custkey as k from orders where o_orderstatus = 'P') select t.k, t.at from t left join live on t.k = live.k where live.k is null order by t.at desc, t.k limit 500"""
)
def tombstones(spark, sf):
    dead = table(spark, sf, "customer").where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("at"))
    live = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return merge.drop_stale_tombstones(dead, live, "k", "at")


@query("select o.o_orderkey, c.c_custkey as match_id from orders o left join (select c_nationkey * 1000 + (c_custkey % 40) as key, min(c_custkey) as c_custkey from customer group by 1 having count(*) = 1) c on c.key = o.o_custkey % 25000")
def unique_match(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 25000).alias("key"))
    right = table(spark, sf, "customer").select((F.col("c_nationkey") * 1000 + F.col("c_custkey") % 40).cast("long").alias("key"), F.col("c_custkey").alias("match_id"))
    return match.unique_match(left, right, "key", "match_id").select("o_orderkey", "match_id")


_SQL_CANDIDATES = """select o_orderkey, case when p_partkey is null then 'catalog' end as r1, case when o_orderdate > timestamp '2001-01-01' and o_orderkey % 3 = 0 then 'deadline' end as r2,
    case when not (o_orderdate > timestamp '2001-01-01' and o_orderkey % 3 = 0) and strftime(o_orderdate + interval 5 day, '%Y-%m-%d') > strftime(o_orderdate + (o_orderkey % 9) * interval 1 day, '%Y-%m-%d') then 'order' end as r3,
    case when not (o_orderdate > timestamp '2001-01-01' and o_orderkey % 3 = 0) and date_trunc('day', o_orderdate + (o_orderkey % 9) * interval 1 day) + interval 86399 second - interval 9 hour < timestamp '2001-08-01' - interval 35 day then 'expired' end as r4,
    case when o_orderkey % 17 = 0 then 'no_host' end as r5 from orders left join part on o_orderkey % 3000 = p_partkey"""


@query(f"select o_orderkey, array_to_string(list_filter([r1, r2, r3, r4, r5], lambda x: x is not null), ',') as reasons, r1 is null and r2 is null and r3 is null and r4 is null and r5 is null as accepted from ({_SQL_CANDIDATES})")
def gate_reasons(spark, sf):
    return _gated(spark, sf).select("o_orderkey", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query(
    f"""select status, count(*) as n from (select case when r1 is null and r2 is null and r3 is null and r4 is null and r5 is null then 'published' when r4 is not null or r1 is not null then 'rejected' else 'review' end as status from ({_SQL_CANDIDATES})) group by status"""
)
def gate_split(spark, sf):
    return _gated(spark, sf).groupBy(gate.split_status(F.col("reasons"), "expired|catalog").alias("status")).agg(F.count("*").alias("n"))


@query(
    f"""select count(*) as candidates, count(*) filter (status = 'published') as published, count(*) filter (status = 'duplicate') as duplicate, count(*) filter (status = 'review') as review, count(*) filter (status = 'rejected') as rejected
    from (select case when r1 is null and r2 is null and r3 is null and r4 is null and r5 is null then 'published' when r4 is not null or r1 is not null then 'rejected' else 'review' end as status from ({_SQL_CANDIDATES}))"""
)
def gate_summary(spark, sf):
    return health.quality_summary(_gated(spark, sf).withColumn("status", gate.split_status(F.col("reasons"), "expired|catalog")), "status")


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda n: F.date_format(F.col("o_orderdate") + F.make_dt_interval(n), "yyyy-MM-dd")
    late = (F.col("o_orderdate") > F.lit("2001-01-01").cast("timestamp")) & (F.col("o_orderkey") % 3 == 0)
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("catalog_id"))
    rows = table(spark, sf, "orders").join(parts, F.col("o_orderkey") % 3000 == F.col("catalog_id"), "left")
    rows = rows.select(
        "o_orderkey",
        "catalog_id",
        day(F.lit(5)).alias("applyStartDate"),
        F.when(~late, day((F.col("o_orderkey") % 9).cast("int"))).alias("applyEndDate"),
        F.lit("").alias("rawApplyText"),
        F.when(F.col("o_orderkey") % 17 != 0, F.lit("https://shop.example.com/e/1")).alias("url"),
        F.lit("https://list.example.com/").alias("sourceUrl"),
        F.lit("web").alias("sourceKind"),
        F.lit(False).alias("officialNotice"),
        F.lit(True).alias("destinationVerified"),
    )
    return gate.evaluate(rows, F.expr(NOW), ["blocked.example.org"])


@query("select o_orderkey from orders where date_trunc('day', o_orderdate) + interval 86399 second - interval 9 hour >= timestamp '2001-08-01' - interval 35 day or o_orderkey % 13 = 0")
def retention_filter(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("end"), F.lit("").alias("start"))
    return gate.keep_relevant(rows, ["end", "start"], F.expr(NOW)).select("o_orderkey")


# ---- events: state over runs


_SQL_NEW = "select event_id, user_id, ts, sha256(event_type || props) as fp from events"


@query(
    f"""select event_id, user_id, row_number() over w = 1 as first_seen, coalesce(lag(fp) over w <> fp, false) as changed, min(ts) over (w rows between unbounded preceding and current row) as first_seen_at from ({_SQL_NEW}) window w as (partition by user_id order by ts, event_id)"""
)
def newness(spark, sf):
    return state.newness(_observed(spark, sf), "user_id", "ts", "fp", "event_id").select("event_id", "user_id", "first_seen", "changed", "first_seen_at")


def _observed(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.sha2(F.concat("event_type", "props"), 256).alias("fp"))


@query(
    f"""select count(*) as observed, count(*) filter (f) as new, count(*) filter (not f) as known, count(*) filter (c) as changed from (select row_number() over w = 1 as f, coalesce(lag(fp) over w <> fp, false) as c from ({_SQL_NEW}) window w as (partition by user_id order by ts, event_id))"""
)
def newness_metrics(spark, sf):
    return state.metrics(state.newness(_observed(spark, sf), "user_id", "ts", "fp", "event_id"))


@query(
    """with old as (select user_id as key, max(ts) as at, max_by(event_type, event_id) as fp from events where ts < timestamp '2024-01-15' and user_id % 3 <> 0 group by 1), new as (select user_id as key, max(event_type) as fp from events where ts >= timestamp '2024-01-15' and user_id % 5 <> 0 group by 1)
    select coalesce(old.key, new.key) as key, coalesce(new.fp, old.fp) as fingerprint, case when old.key is null then 'new' when new.key is null then 'unseen' when old.fp <> new.fp then 'changed' else 'known' end as outcome from old full outer join new on old.key = new.key"""
)
def state_upsert(spark, sf):
    e = table(spark, sf, "events")
    cut = F.lit("2024-01-15").cast("timestamp")
    old = e.where((F.col("ts") < cut) & (F.col("user_id") % 3 != 0)).groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.max("ts").alias("last_changed_at"), F.max_by("event_type", "event_id").alias("fingerprint"))
    new = e.where((F.col("ts") >= cut) & (F.col("user_id") % 5 != 0)).select(F.col("user_id").alias("key"), F.col("event_type").alias("fingerprint"))
    return state.apply_run(old, new, F.expr(NOW)).select("key", "fingerprint", "outcome")


@query(
    """select event_type, user_id, last_seen from (select *, row_number() over (partition by event_type order by last_seen desc, user_id) as r from (select event_type, user_id, max(ts) as last_seen from events group by all) where last_seen >= timestamp '2024-02-01' - interval 20 day) where r <= 40"""
)
def state_retention(spark, sf):
    seen = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("last_seen"))
    return state.retain(seen, "event_type", "last_seen", F.lit("2024-02-01").cast("timestamp"), days=20, most=40, tie="user_id")


@query(
    """select user_id from (select user_id, max(ts) as last, 5 + (user_id % 4) * 15 as wait from events group by user_id) where user_id % 10 = 0 or timestamp '2024-01-30 23:30:00' - last >= wait * interval 1 minute"""
)
def due_sources(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last")).withColumn("last", F.when(F.col("user_id") % 10 != 0, F.col("last")))
    return registry.due(last, F.col("last"), (F.lit(5) + (F.col("user_id") % 4) * 15).cast("int"), F.lit("2024-01-30 23:30:00").cast("timestamp")).select("user_id")


@query(
    f"""select key, max(first_seen::int) = 1 as first_seen, count(*) as observed, count(*) filter (changed) as changed from (select user_id::varchar as key, row_number() over w = 1 as first_seen, coalesce(lag(fp) over w <> fp, false) as changed from (select user_id, ts, sha256(event_type || props) as fp from events) window w as (partition by user_id order by ts, fp)) group by key"""
)
def newness_stream(spark, sf):
    """The same over Structured Streaming: the table read as a stream until it is used up."""
    from harrow.streaming.newness import stream_newness

    scratch = Scratch(spark, "newness-stream")
    source = f"{sf}/events.parquet"
    schema = spark.read.parquet(source).schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    rows = (feed.parquet(source) if _is_dir(spark, source) else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)).select(
        F.col("user_id").cast("string").alias("key"), F.col("ts").alias("run"), F.sha2(F.concat("event_type", "props"), 256).alias("fingerprint")
    )
    out = f"{scratch.root}/out"
    running = stream_newness(rows).writeStream.format("parquet").option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).outputMode("append").start(out)
    running.awaitTermination()
    return spark.read.parquet(out).groupBy("key").agg(F.max("first_seen").alias("first_seen"), F.count("*").alias("observed"), F.count_if("changed").alias("changed"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


@query(
    """select event_type, n as failed, case when event_type = 'error' then 'access_blocked' when event_type = 'click' then 'temporary_fetch_error' else 'source_error' end as failure_class, case when event_type in ('error', 'click') then 'warning' else 'error' end as severity from (select event_type, count(*) as n from events group by 1)"""
)
def failure_classes(spark, sf):
    message = F.when(F.col("event_type") == "error", F.lit("HTTP 403 at https://a.example/x")).when(F.col("event_type") == "click", "fetch failed: timed out").otherwise("bad parse")
    rows = table(spark, sf, "events").withColumn("f", health.failure_class(message))
    return rows.groupBy("event_type", F.col("f.failure_class").alias("failure_class"), F.col("f.severity").alias("severity")).agg(F.count("*").alias("failed"))


@query(
    """select user_id, case when not ok then 'source-fetch-failed' when links = 0 and returned = 0 then 'page-contained-no-links-or-was-client-rendered' when returned = 0 then 'links-found-but-none-matched-discovery-rules' when fetched = 0 then 'candidate-pages-could-not-be-fetched'
    when relevant = 0 then 'candidate-pages-did-not-look-relevant' when items = 0 then 'relevant-pages-were-not-parsed-into-items' else 'no-current-items' end as reason
    from (select user_id, count(*) filter (event_type = 'error') < 20 as ok, count(*) filter (event_type = 'view' and value > 5) as links, count(*) filter (event_type = 'view' and value > 30) as returned, count(*) filter (event_type = 'click' and value > 40) as fetched, count(*) filter (event_type = 'signup' and value > 30) as relevant, count(*) filter (event_type = 'purchase' and value > 50) as items from events group by 1)"""
)
def status_ladder(spark, sf):
    n = lambda kind, over: F.count_if((F.col("event_type") == kind) & (F.col("value") > over))
    rows = table(spark, sf, "events").groupBy("user_id").agg(
        (F.count_if(F.col("event_type") == "error") < 20).alias("ok"), n("view", 5).alias("links"), n("view", 30).alias("returned"), n("click", 40).alias("fetched"), n("signup", 30).alias("relevant"), n("purchase", 50).alias("items")
    )
    return rows.select("user_id", health.empty_reason(F.col("ok"), F.lit(True), *map(F.col, ("links", "returned", "fetched", "relevant", "items"))).alias("reason"))


# ---- suppliers as a registry, customers as accounts


@query(
    """with s as (select s_suppkey as ord, case when s_suppkey % 9 = 0 then '' else 'src-' || (s_suppkey % 90) end as id0, trim(s_name) as name, case when s_suppkey % 13 = 0 then '' else 'https://shop' || (s_suppkey % 70) || '.example.com/' end as url, s_suppkey % 130 - 10 as p, s_acctbal from supplier),
    n as (select ord, case when id0 = '' then 'source-' || substr(sha256(name || chr(10) || url), 1, 12) else id0 end as id, url, greatest(0, least(100, p)) as priority, id0 = '' as generated from s),
    c as (select *, row_number() over (partition by id order by ord) > 1 as copy, url <> '' and row_number() over (partition by regexp_replace(url, '/$', '') order by ord) > 1 as same_url from n)
    select ord, id, priority::int as priority, case when priority >= 90 then 5 when priority >= 70 then 15 when priority >= 40 then 30 else 60 end as interval_minutes, url <> '' and not copy as enabled, case when url = '' then 'unknown' else 'website' end as platform,
        array_to_string(list_filter([case when url = '' then 'url missing' end, case when copy then 'id repeated' end], lambda x: x is not null), ',') as errors, array_to_string(list_filter([case when generated then 'id generated' end, case when same_url then 'url repeated' end], lambda x: x is not null), ',') as warnings from c"""
)
def registry_normalise(spark, sf):
    done = registry.normalise(_registry(spark, sf))
    return done.select("ord", "id", "priority", "interval_minutes", "enabled", "platform", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def _registry(spark, sf):
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    return table(spark, sf, "supplier").select(
        k.alias("ord"),
        F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("src-"), (k % 90).cast("string"))).alias("id"),
        F.col("s_name").alias("name"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("https://shop"), (k % 70).cast("string"), F.lit(".example.com/"))).alias("url"),
        none.alias("parser"), F.lit(True).alias("enabled"), none.alias("platform"), none.alias("official_status"), (F.col("s_acctbal") > 0).alias("official"), none.alias("source_kind"), none.alias("area"),
        (k % 130 - 10).cast("string").alias("priority"), none.alias("interval_minutes"),
    )


@query(
    """with s as (select s_suppkey as ord, case when s_suppkey % 9 = 0 then s_suppkey::varchar else 'src-' || (s_suppkey % 90) end as id, s_suppkey % 13 = 0 as bad, s_acctbal > 0 as official from supplier), c as (select *, not bad and row_number() over (partition by id order by ord) = 1 as enabled from s)
    select count(*) as total, count(*) filter (enabled) as enabled, count(*) filter (not enabled) as disabled, count(*) filter (enabled and official) as official from c"""
)
def registry_summary(spark, sf):
    return registry.summary(registry.normalise(_registry(spark, sf))).select("total", "enabled", "disabled", "official")


@query(
    """with u as (select c_nationkey as author_id, max_by(c_name, c_custkey) as username from customer group by 1), a as (select lower(c_name) as username, c_mktsegment as area from customer where c_custkey % 2 = 0)
    select e.event_id, u.username, a.area from events e left join u on e.user_id % 30 = u.author_id left join a on lower(u.username) = a.username"""
)
def posts_accounts(spark, sf):
    posts = table(spark, sf, "events").select("event_id", (F.col("user_id") % 30).alias("author_id"))
    c = table(spark, sf, "customer")
    users = c.select(F.col("c_nationkey").cast("long").alias("id"), F.col("c_name").alias("username"), F.col("c_custkey").alias("ord"))
    accounts = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("username"), F.col("c_mktsegment").alias("area"))
    return match.posts_with_accounts(posts, users, accounts).select("event_id", "username", "area")


@query("select (s_suppkey // 6)::int as batch, string_agg('from:' || s_name, ' OR ' order by s_suppkey) as query from supplier group by 1")
def query_batches(spark, sf):
    from harrow.sources.tables import query_batches as batches

    return batches(table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("username")), "s_suppkey")


# ---- conversations: labelled sections, exploding products


@query(
    """with l as (select conv_id, turn, string_split(text, chr(10)) as l from conversations), a as (select *, list_position(list_transform(l, lambda s: length(s) > 0 and upper(s[1]) = 'T'), true) as pos from l)
    select conv_id, turn, case when pos is null or pos = 0 then 0 else length(array_to_string(l[pos:pos + 3], chr(10))) end as n_chars from a"""
)
def label_section(spark, sf):
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("l"))
    marked = lines.withColumn("m", F.transform("l", lambda s: F.when(F.upper(F.substring(s, 1, 1)) == "T", F.concat(F.lit("\u0001"), s)).otherwise(s)))
    first = marked.withColumn("at", F.array_position(F.transform("m", lambda s: s.startswith("\u0001")), True).cast("int"))
    section = F.when(F.col("at") > 0, F.array_join(F.slice("l", F.greatest("at", F.lit(1)), F.lit(4)), "\n")).otherwise("")
    return first.select("conv_id", "turn", F.length(section).cast("long").alias("n_chars"))


@query(
    """select conv_id, turn, i::int as n, p as product from (select conv_id, turn, ps[1:12] as ps, unnest(range(1, len(ps[1:12]) + 1)) as i, ps[i] as p from (select conv_id, turn, list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_position(w, w[i]) = i then w[i] end), lambda x: x is not null) as ps from (select conv_id, turn, regexp_extract_all(text, '[A-Z][a-z]{3,}') as w from conversations)))"""
)
def explode_products(spark, sf):
    return parse.explode_products(table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)).alias("products")), "products", 12)


# ---- rankings and catalogs


@query(
    """with l as (select conv_id, turn, text, (case when regexp_matches(text, 'the') then 10 else 0 end) + (case when regexp_matches(text, 'ion') then 15 else 0 end) + (case when length(text) > 300 then 5 else 0 end) as s from conversations where role = 'user'),
    once as (select conv_id, text, max(s) as s, min(turn) as o from l group by all), r as (select *, row_number() over (partition by conv_id order by s desc, length(text) desc, o) as r, max(s) over (partition by conv_id) as top from once)
    select conv_id, sha256(min_by(text, r)) as best_sha256, max(s)::int as score, count(*) filter (r > 1 and s >= top - 18) as n_alternatives from r where r <= 8 group by conv_id"""
)
def line_choice(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    score = rank.pattern_score(F.col("text"), [("the", 10), ("ion", 15)]) + F.when(F.length("text") > 300, 5).otherwise(0)
    best = rank.best_with_alternatives(rows, ["conv_id"], "text", score, "turn")
    return best.select("conv_id", F.sha2("text", 256).alias("best_sha256"), "score", F.size("alternatives").cast("long").alias("n_alternatives"))


@query("select p_brand, p_partkey as best_part, s as score from (select *, row_number() over (partition by p_brand order by s desc, p_partkey) as r from (select *, p_size * 2 + case when p_type = 'ECONOMY' then 7 else 0 end as s from part)) where r = 1")
def best_image(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_partkey").alias("best_part"), (F.col("p_size") * 2 + F.when(F.col("p_type") == "ECONOMY", 7).otherwise(0)).alias("s"))
    return rank.best_of(rows, ["p_brand"], "best_part", F.col("s"), "p_partkey")


@query("select p_brand, p_partkey, s as score, r::int as rank from (select *, row_number() over (partition by p_brand order by s desc, p_partkey) as r from (select *, p_size - 20 as s from part) where s > -5) where r <= 3")
def ocr_image_topk(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    return rank.top_by_score(rows, ["p_brand"], F.col("p_size") - 20, "p_partkey", -5, 3).select("p_brand", "p_partkey", "score", "rank")


@query("select c_nationkey, c_name as title from (select *, row_number() over (partition by c_nationkey order by c_mktsegment <> 'BUILDING', -(c_custkey % 5), case when c_mktsegment = 'BUILDING' then -(c_custkey % 7) else 0 end, c_custkey) as r from customer) where r = 1")
def best_title(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", F.col("c_name").alias("title"), "c_mktsegment", "c_custkey")
    return rank.best_title(rows, ["c_nationkey"], "title", F.col("c_mktsegment") == "BUILDING", F.col("c_custkey") % 5, F.col("c_custkey") % 7, "c_custkey")


@query(
    """select p_partkey, array_to_string(list_filter([case when not ok then 'name' end, case when p_size % 7 = 0 then 'release_date' end, case when p_size % 5 = 0 then 'image' end, case when p_size % 11 = 0 then 'official_url' end, case when conf < 0.8 then 'confidence' end], lambda x: x is not null), ',') as lacks, conf as confidence
    from (select *, length(p_name) between 4 and 90 and not regexp_matches(p_name, 'widget') as ok, round(0.25 + case when p_size % 7 <> 0 then 0.25 else 0 end + case when p_size % 5 <> 0 then 0.25 else 0 end + case when p_size % 11 <> 0 then 0.15 else 0 end + case when length(p_name) between 4 and 90 and not regexp_matches(p_name, 'widget') then 0.1 else 0 end, 2)::double as conf from part)"""
)
def catalog_completeness(spark, sf):
    size = F.col("p_size")
    ok = products.plausible_name(F.col("p_name"), "widget", "none", "series")
    conf = products.product_confidence(size % 7 != 0, size % 5 != 0, size % 11 != 0, ok)
    rows = table(spark, sf, "part").withColumn("confidence", conf)
    lacks = products.completeness_reasons(ok, F.when(size % 7 != 0, "2026-01-01"), F.when(size % 5 != 0, "a.png"), F.when(size % 11 != 0, "https://a.example.jp/"), F.col("confidence"))
    return rows.select("p_partkey", F.array_join(lacks, ",").alias("lacks"), "confidence")


@query("select p_partkey, 'pcg-' || '2026-01-' || lpad((p_size % 28 + 1)::varchar, 2, '0') || '-' || substr(sha1(p_name), 1, 12) as id from part")
def product_ids(spark, sf):
    day = F.concat(F.lit("2026-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))
    return table(spark, sf, "part").select("p_partkey", products.product_id(day, F.col("p_name")).alias("id"))


@query(
    f"""select page_id, reason is null as ok, reason from (select page_id, case when {_sql_host("url")} = '' then 'no_host' when {_sql_host("url")} = 'spam-farm.example.org' or ends_with({_sql_host("url")}, '.spam-farm.example.org') then 'blocked' when regexp_matches({_sql_host("url")}, 'x\\.com$|twitter\\.com$') then 'social'
    when page_id % 9 = 0 then 'not_fetched' when not regexp_matches(lower(html), 'the') then 'language' when not regexp_matches(lower(html), 'ntly') then 'product' end as reason from pages)"""
)
def destination_check(spark, sf):
    text = F.when(F.col("page_id") % 9 != 0, F.col("html"))
    checked = products.verify_destination(F.col("url"), text, F.lit(""), ["spam-farm.example.org"], "the", "ntly")
    return table(spark, sf, "pages").select("page_id", checked.alias("c")).select("page_id", "c.ok", "c.reason")
