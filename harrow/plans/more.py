"""More registered queries: operators over records, addresses and rankings, on stand-in tables; those of notices are in notice_queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import dates, urls
from harrow.functions import text as tx
from harrow.operators import catalog_pages, discover, gate, health, match, merge, products, rank, records, registry, screen_text
from harrow.plans import gate_queries, notice_queries, reader_queries, state_queries  # noqa: F401  register their queries
from harrow.plans.queries import ORACLES, QUERIES, _SQL_LINKS, _registry, _sql_host, _sql_part, _sql_text, query
from harrow.session import table

_ALIASES = (("brand1", "one"), ("brand2|brand3", "few"))


# ---- keys and entered records


@query(
    """select p_partkey, case when regexp_matches(s, 'brand1') then 'one' when regexp_matches(s, 'brand2|brand3') then 'few' else s end || '|' || left(p, 12) || '|' || case when p_size % 3 = 0 then '2026-01-' || lpad(p_size::varchar, 2, '0') when p_size % 3 = 1 then '2025-12-01' when p_size % 2 = 0 then 'shop.example.com' else '' end as key
    from (select *, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') as s, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') as p from part)"""
)
def record_keys(spark, sf):
    size = F.col("p_size")
    clean = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    day = F.when(size % 3 == 0, F.concat(F.lit("2026-01-"), F.lpad(size.cast("string"), 2, "0")))
    host = records.action_host(F.lit("https://x.com/post"), F.when(size % 2 == 0, F.lit("https://www.shop.example.com/a")))
    key = records.dedupe_key(records.canonical_shop(clean("p_brand"), _ALIASES), clean("p_name"), [day, F.when(size % 3 == 1, F.lit("2025-12-01"))], host, 12)
    return table(spark, sf, "part").select("p_partkey", key.alias("key"))


@query(
    """select c_custkey, case when c_custkey % 5 = 0 then '' else left(trim(c_name), 100) end as shop, c_mktsegment as product, case when c_nationkey = 3 then '全国' else left('area ' || c_nationkey || ' of the long names', 20) end as area, case when c_custkey % 4 = 0 then '2026-01-02' else '2026-01-05' end as "applyEndDate",
    case when c_custkey % 3 = 0 then 'https://a.example.jp/' || c_custkey else '' end as url, case when c_custkey % 3 = 0 then 'https://a.example.jp/' || c_custkey else 'id' || c_custkey end as "externalId", case when c_custkey % 3 = 0 then 'url:https://a.example.jp/' || c_custkey else '' end as "sourceKey",
    array_to_string(list_filter([case when c_custkey % 5 = 0 then 'shop' end, case when c_custkey % 7 = 0 then 'resultStartDate' end, case when c_custkey % 3 <> 0 then 'url' end], lambda x: x is not null), ',') as errors from customer"""
)
def entered_records(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 5 != 0, F.concat(F.lit("  "), "c_name")).alias("shop"), F.col("c_mktsegment").alias("product"), F.when(F.col("c_nationkey") != 3, F.concat(F.lit("area "), F.col("c_nationkey").cast("string"), F.lit(" of the long names"))).alias("area"),
        F.when(k % 4 == 0, F.lit("2026-01-02T00:00")).alias("applyEndDate"), F.lit("2026-01-05").alias("deadline"), F.when(k % 7 != 0, F.lit("2026-01-09")).alias("resultDate"), F.concat(F.lit("id"), k.cast("string")).alias("externalId"),
        F.when(k % 3 == 0, F.concat(F.lit("https://a.example.jp/"), k.cast("string"))).otherwise(F.lit("http://b.example.jp/")).alias("url"),
    )
    out = records.normalise_entered(rows)
    return out.select("c_custkey", "shop", "product", "area", "applyEndDate", "url", "externalId", "sourceKey", F.array_join("errors", ",").alias("errors"))


@query(
    """select o_orderkey, not (o_orderkey % 11 = 0 or o_orderkey % 13 = 0) and (o_orderstatus = 'P' or o_orderkey % 7 = 0 or (o_custkey % 2 = 0 and (o_orderstatus = 'F' or o_orderkey % 5 = 0 or o_custkey % 4 >= 2))) as managed from orders"""
)
def managed_remote(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    managed = records.is_managed_remote(
        k % 11 == 0, F.when(k % 13 == 0, True), F.when(F.col("o_orderstatus") == "P", "remote"), F.when(k % 7 == 0, "r"), F.when(c % 2 == 0, "e"), F.col("o_orderstatus") == "F", F.when(k % 5 == 0, "2026"), (c % 4).cast("int")
    )
    return table(spark, sf, "orders").select("o_orderkey", managed.alias("managed"))


@query("select conv_id, turn, role = 'assistant' and (turn % 3 = 0 or regexp_matches(coalesce(text, ''), 'store|counter')) as notice, turn % 5 = 0 or regexp_matches(coalesce(text, ''), '(?i)(?:app)|(?:phone)') as intent from conversations")
def notices_and_intents(spark, sf):
    t, text = F.col("turn"), F.col("text")
    notice = records.store_notice(F.col("role") == "assistant", F.when(t % 3 != 0, "https://a.example.jp"), text, "store|counter")
    intent = records.app_intent(F.when(t % 5 == 0, "app"), [F.lit(None).cast("string"), F.lit("")], text, ["app", "phone"])
    return table(spark, sf, "conversations").select("conv_id", "turn", notice.alias("notice"), intent.alias("intent"))


@query(
    """select p_partkey, case when p_type like '%A%' then case when p_size % 2 = 0 then 'a' when p_size % 3 = 0 then 'g' when p_size % 5 = 0 then 'o' else 'i' end when p_type like '%S%' then 'i' else case when p_size % 5 = 0 then 'o' when p_size % 3 = 0 then 'g' else 'i' end end as link from part"""
)
def fallback_links(spark, sf):
    size, kind = F.col("p_size"), F.col("p_type")
    on = records.device(F.when(kind.contains("A"), "Linux; Android 14").when(kind.contains("S"), "iPhone OS").otherwise("X11"))
    link = records.fallback_link(on, F.when(size % 2 == 0, "a"), F.lit("i"), F.when(size % 3 == 0, "g"), F.when(size % 5 == 0, "o"))
    return table(spark, sf, "part").select("p_partkey", link.alias("link"))


@query("select user_id, array_to_string(list(event_id order by event_id)[1:3], ',') as samples from events where event_type = 'error' group by user_id")
def error_samples(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'error'").select("user_id", "event_id")
    return records.first_samples(rows, ["user_id"], "event_id", "event_id").select("user_id", F.array_join(F.transform("samples", lambda s: s.cast("string")), ",").alias("samples"))


_LADDER = "user_id % 9 as sources, case when user_id % 4 = 0 then user_id % 9 else user_id % 2 end as failed, count(*) filter (event_type = 'view' and value > 60) as links, count(*) filter (event_type = 'click' and value > 60) as fetched, user_id % 3 as fetch_failed, count(*) filter (event_type = 'signup' and value > 40) as relevant, count(*) filter (event_type = 'purchase' and value > 60) as items"


@query(
    f"""select user_id, search, case when n > 0 then 'partial' when user_id % 6 = 1 or search in ('no_candidates', 'no_relevant_pages', 'partial') then 'degraded' else 'ok' end as status, n as n_reasons from (
    select *, ((user_id % 10 = 0)::int + (user_id % 15 = 0)::int + (search in ('search_failed', 'candidate_fetch_failed', 'parser_returned_zero'))::int)::bigint as n from (
    select *, case when sources = 0 then 'not_configured' when failed = sources then 'search_failed' when links = 0 then 'no_candidates' when fetched = 0 and fetch_failed > 0 then 'candidate_fetch_failed' when relevant = 0 then 'no_relevant_pages' when items = 0 then 'parser_returned_zero'
      when failed > 0 or fetch_failed > 0 then 'partial' else 'ok' end as search from (select user_id, {_LADDER} from events group by user_id)))"""
)
def search_ladder(spark, sf):
    n = lambda kind, over: F.count_if((F.col("event_type") == kind) & (F.col("value") > over))
    u = F.col("user_id")
    rows = table(spark, sf, "events").groupBy("user_id").agg(n("view", 60).alias("links"), n("click", 60).alias("fetched"), n("signup", 40).alias("relevant"), n("purchase", 60).alias("items"))
    rows = rows.withColumn("sources", u % 9).withColumn("failed", F.when(u % 4 == 0, u % 9).otherwise(u % 2)).withColumn("fetch_failed", u % 3)
    rows = rows.withColumn("search", records.search_status(*map(F.col, ("sources", "failed", "links", "fetched", "fetch_failed", "relevant", "items"))))
    state = records.status_with_search(F.when(u % 10 == 0, 1).otherwise(0), F.when(u % 6 == 1, 1).otherwise(0), u % 15 == 0, F.lit(0), F.col("search"))
    return rows.select("user_id", "search", state.alias("s")).select("user_id", "search", "s.status", F.size("s.reasons").cast("long").alias("n_reasons"))


@query("select p_partkey, p_name from part where not (p_size % 2 = 0 and not (length(p_name) between 4 and 90 and not regexp_matches(p_name, 'widget')))")
def pruned_catalog(spark, sf):
    rows = table(spark, sf, "part").withColumn("source", F.lit("x")).withColumn("lastSeenAt", F.lit("y"))
    kept = records.prune_products(rows, F.when(F.col("p_size") % 2 == 0, True), products.plausible_name(F.col("p_name"), "widget", "none", "series"))
    return records.public_products(kept).drop("p_brand", "p_type", "p_size", "p_retailprice")


@query(
    """select s_suppkey as ord, s_suppkey % 4 <> 0 and s_suppkey % 2 = 0 as discovery_on, true as same_host, case when s_suppkey % 4 <> 0 and s_suppkey % 3 = 0 then 'a,b' end as include, case when s_suppkey % 4 <> 0 and s_suppkey % 5 = 0 then 'odd' when s_suppkey % 4 <> 0 and s_suppkey % 5 = 1 then 'generic' else '' end as child,
    (case when s_suppkey % 4 = 0 then 8 else greatest(1, least(100, s_suppkey % 130)) end)::int as most, s_suppkey % 4 <> 0 and s_suppkey % 5 = 0 as child_warned, 'kept' as note from supplier"""
)
def registry_discovery(spark, sf):
    k = F.col("ord")
    none = F.lit(None).cast("array<string>")
    texts = F.when(k % 3 == 0, F.array(*map(F.lit, [" a ", "", "a", "b"])))
    child = F.when(k % 5 == 0, " odd ").when(k % 5 == 1, "generic")
    struct = F.struct(
        (k % 2 == 0).alias("enabled"), F.lit(None).cast("boolean").alias("same_host"), texts.alias("include"), none.alias("exclude"), none.alias("allowed_hosts"), none.alias("required_path"), none.alias("page_keywords"), child.alias("child_parser"), (k % 130).alias("most")
    )
    done = registry.normalise(_registry(spark, sf).withColumn("discovery", F.when(k % 4 != 0, struct)).withColumn("note", F.lit("kept")))
    warned = F.array_contains("warnings", "child parser unknown")
    return done.select("ord", F.col("discovery.enabled").alias("discovery_on"), "discovery.same_host", F.array_join("discovery.include", ",").alias("include"), F.col("discovery.child_parser").alias("child"), "discovery.most", warned.alias("child_warned"), "note")


# ---- operators that had no query of their own


@query("select coalesce(d.c_custkey, r.c_custkey) as c_custkey, trim(concat_ws(' ', d.c_name, r.c_mktsegment)) as text, coalesce(r.score, d.score) as score from (select c_custkey, c_name, c_acctbal as score from customer where c_custkey % 2 = 0) d full outer join (select c_custkey, c_mktsegment, c_acctbal + 1 as score from customer where c_custkey % 3 = 0) r using (c_custkey)")
def candidates_union(spark, sf):
    c = table(spark, sf, "customer")
    a = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("text"), F.col("c_acctbal").alias("score"))
    b = c.where("c_custkey % 3 = 0").select("c_custkey", F.col("c_mktsegment").alias("text"), (F.col("c_acctbal") + 1).alias("score"))
    return merge.merge_candidates(a, b, "c_custkey", "text")


@query("select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders where o_custkey % 4 <> 0) where r = 1 union all select o_orderkey, null from orders where o_custkey % 4 = 0")
def first_claims(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("o_custkey"), "o_totalprice")
    return match.first_claim(rows, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_custkey")


@query("select p_partkey, case when regexp_matches(p_name, '(?i)(?:red)|(?:blue)') then 'colour' when regexp_matches(p_name, '(?i)(?:a.e)') then 'vowels' end as profile from part")
def profiles(spark, sf):
    return table(spark, sf, "part").select("p_partkey", match.first_profile(F.col("p_name"), [("colour", ["red", "blue"]), ("vowels", ["a.e"])]).alias("profile"))


@query(
    """select o_orderkey, case when o_custkey % 2 = 0 and not o_orderpriority = '1-URGENT' and (o_orderkey % 5 = 0 or d >= strftime(o_orderdate - interval 3 day, '%Y-%m-%d')) and d <= strftime(o_orderdate + (o_orderkey % 4) * interval 1 day, '%Y-%m-%d') then d end as start from (select *, strftime(o_orderdate + ((o_orderkey % 9)::int - 4) * interval 1 day, '%Y-%m-%d') as d from orders)"""
)
def release_starts(spark, sf):
    day = lambda n: F.date_format(F.col("o_orderdate") + F.make_dt_interval(n.cast("int")), "yyyy-MM-dd")
    k = F.col("o_orderkey")
    start = match.fill_start(None, day(k % 9 - 4), F.col("o_orderpriority"), F.when(k % 5 != 0, day(F.lit(-3))), day(k % 4), F.col("o_custkey") % 2 == 0, "1-URGENT")
    return table(spark, sf, "orders").select("o_orderkey", start.alias("start"))


@query(
    """select doc_id, round(coalesce(c, 0) + case when doc_id % 3 <> 0 then 0.3 else 0 end + case when doc_id % 2 = 0 then 0.15 else 0 end + case when n_chars > 900 then 0.1 else 0 end + case when lang = 'en' then 0.05 else 0 end, 6)::double as score from (select *, case when doc_id % 5 <> 0 then 0.6 end as c from documents)"""
)
def record_quality(spark, sf):
    d = F.col("doc_id")
    score = merge.quality_score(F.when(d % 5 != 0, F.lit(0.6)), d % 3 == 0, d % 2 == 0, F.col("n_chars") > 900, F.col("lang") == "en")
    return table(spark, sf, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query("select page_id, case when h <> '' then regexp_replace(regexp_extract(url, '^([A-Za-z]+://[^?#]+)', 1), '/$', '') else '' end as bare, h as host from (select *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\s]+)', 1)), ':\\d+$', ''), '^www\\.', '') as h from pages)")
def revisit_addresses(spark, sf):
    bare = urls.canonical_url(F.regexp_replace("url", r"\?.*$", ""), urls.REVISIT)
    return table(spark, sf, "pages").select("page_id", bare.alias("bare"), urls.host(F.col("url")).alias("host"))


@query("select page_id, case when page_id % 3 = 0 then 'https://docs.google.com/forms/d/e/K' || page_id || '/viewform' when page_id % 3 = 1 then 'https://forms.gle/' || page_id else '' end as form, case when page_id % 4 = 0 then 'slug-' || page_id else '' end as slug from pages")
def form_addresses(spark, sf):
    k = F.col("page_id").cast("string")
    form = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://docs.google.com/forms/u/0/d/e/K"), k, F.lit("/formResponse?usp=x"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://forms.gle/"), k, F.lit("/#a"))).otherwise(F.col("url"))
    form = F.regexp_replace(form, "/u/0/", "/")
    event = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://t.livepocket.jp/e/SLUG-"), k, F.lit("?a=1"))).otherwise(F.lit("https://t.livepocket.jp/x"))
    return table(spark, sf, "pages").select("page_id", urls.form_url(form).alias("form"), urls.event_slug(event).alias("slug"))


@query(
    """select o_orderkey, case when o_orderkey % 3 = 0 then 'url:https://a.example.jp/' || o_orderkey || '|variant:' || 'shopa|' || lower(o_orderstatus) || '|2026-01-01' when o_orderkey % 3 = 1 then 'id:E' || o_orderkey else 'fallback:shopa|' || lower(o_orderstatus) || '|2026-01-01' end as key from orders"""
)
def identity_keys(spark, sf):
    k = F.col("o_orderkey")
    link = F.when(k % 3 == 0, F.concat(F.lit("https://A.example.jp/"), k.cast("string"), F.lit("/?utm_source=x")))
    key = urls.identity_key(link, F.lit("Shop - A"), F.col("o_orderstatus"), F.lit("2026-01-01"), F.when(k % 3 == 1, F.concat(F.lit("E"), k.cast("string"))))
    return table(spark, sf, "orders").select("o_orderkey", key.alias("key"))


@query("select event_id, case when event_type = 'error' then 'at [URL] in [PATH] now' else event_type end as message, replace(event_type, 'e', '\\|') as cell from events")
def redacted_messages(spark, sf):
    message = F.when(F.col("event_type") == "error", F.lit("at HTTPS://a.example/x?y=1 in /home/runner/work/z/q.py now")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", tx.redact(message).alias("message"), tx.markdown_cell(F.replace("event_type", F.lit("e"), F.lit("|"))).alias("cell"))


@query(
    """select doc_id, len(s)::bigint as n_windows, sha256(array_to_string(list_transform(s, lambda p: substr(text, greatest(p - 41, 0) + 1, least(p - 1, 40) + 40)), '|')) as windows_sha256 from (select doc_id, text, list_slice(list_filter(list_transform(range(1, len(parts)), lambda i: length(array_to_string(parts[1:i], 'ation')) + 1), lambda p: p > 0), 1, 4) as s from (select doc_id, text, string_split(text, 'ation') as parts from documents))"""
)
def match_windows(spark, sf):
    windows = table(spark, sf, "documents").select("doc_id", tx.context_windows(F.col("text"), "ation", 40, 4).alias("w"))
    return windows.select("doc_id", F.size("w").cast("long").alias("n_windows"), F.sha2(F.array_join("w", "|"), 256).alias("windows_sha256"))


@query("select o_orderkey, strftime(o_orderdate, '%Y') || '-07-01' as raised, case when o_orderkey % 2 = 0 then (year(o_orderdate) - 2) || '-07-01' else strftime(o_orderdate, '%Y') || '-07-01' end as published from orders")
def published_years(spark, sf):
    year = F.year("o_orderdate")
    reference = F.concat(year.cast("string"), F.lit("-06-15"))
    below = F.concat((year - 1).cast("string"), F.lit("-07-01"))
    far = F.when(F.col("o_orderkey") % 2 == 0, F.concat((year - 2).cast("string"), F.lit("-07-01"))).otherwise(below)
    return table(spark, sf, "orders").select("o_orderkey", dates.raise_year(below, reference).alias("raised"), dates.published_year(far, reference).alias("published"))


@query("select o_orderkey, month(o_orderdate) = 7 and day(o_orderdate) = 4 as matches, true as passes from orders")
def weekday_checks(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    names = F.element_at(F.array(*map(F.lit, gate.WEEKDAYS)), F.dayofweek("o_orderdate"))
    own = F.concat(F.lit("1/1(月) "), F.month("o_orderdate").cast("string"), F.lit("月"), F.dayofmonth("o_orderdate").cast("string"), F.lit("日("), names, F.lit(")"))
    fixed = F.concat(F.lit("7/4("), names, F.lit(")"))
    return table(spark, sf, "orders").select("o_orderkey", gate.weekday_matches(fixed, day).alias("matches"), (gate.weekday_matches(own, day) & gate.weekday_matches(F.lit("no date"), day)).alias("passes"))


@query("select c_custkey, ((c_name <> '')::int + (c_mktsegment like 'B%')::int + 1)::int as filled from customer")
def filled_fields(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", health.completeness(F.col("c_name"), F.when(F.col("c_mktsegment").startswith("B"), "b"), F.col("c_acctbal"), F.lit("")).alias("filled"))


@query("select o_custkey, o_orderkey, rank() over (order by o_orderdate desc, o_orderkey) <= 50 as newest from orders qualify newest")
def newest_orders(spark, sf):
    return rank.newest_first(table(spark, sf, "orders"), "o_orderdate", "o_orderkey").limit(50).select("o_custkey", "o_orderkey", F.lit(True).alias("newest"))


@query(
    f"""with p as (select page_id, h, string_split(h, 'ation') as parts from (select page_id, replace(html, '&amp;', '&') as h from pages)), w as (select page_id, h, i, length(array_to_string(parts[1:i], 'ation')) + 1 as pos from (select *, unnest(range(1, len(parts))) as i from p)),
    c as (select page_id, i, {_sql_text("substr(h, greatest(pos - 30, 1), pos - greatest(pos - 30, 1) + 5 + 40)")} as context from w)
    select page_id, count(*) as places, sha256(string_agg(context, '|' order by i)) as contexts_sha256 from c group by page_id"""
)
def embedded_places(spark, sf):
    found = discover.context_links(table(spark, sf, "pages").select("page_id", "html"), "ation", 30, 40)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "context"))), lambda c: c["context"]), "|")
    return found.groupBy("page_id").agg(F.count("*").alias("places"), F.sha2(joined, 256).alias("contexts_sha256"))


@query(
    """select c_custkey, case when c_custkey % 4 <> 0 and (c_custkey % 3 = 0 or c_mktsegment = 'BUILDING') then 'other' when c_custkey % 3 = 0 then '' else c_name end as shop,
    case when c_custkey % 4 <> 0 and (c_custkey % 3 = 0 or c_mktsegment = 'BUILDING') then '店舗' when c_mktsegment = 'BUILDING' then '通販' else '店舗' end as kind from customer"""
)
def merged_readings(spark, sf):
    k = F.col("c_custkey")
    both = screen_text.merged_shop(F.when(k % 3 != 0, F.col("c_name")), F.when(F.col("c_mktsegment") == "BUILDING", "通販").otherwise("店舗"), F.when(k % 4 != 0, "other"), F.lit(None).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", both.alias("b")).select("c_custkey", "b.*")


@query(rf"with {_SQL_LINKS} select page_id, ord::int as ord, url, link_text from absolute where {_sql_host('url')} = {_sql_host('base')} and url <> base and regexp_matches({_sql_part('url', 3)}, '/[a-z]*(?:er|th)[a-z]*(?:/|$)') and regexp_matches(link_text, 'an|e')")
def product_page_links(spark, sf):
    links = discover.extract_links(table(spark, sf, "pages").select("page_id", F.col("url").alias("base"), "html"), base_col="base")
    return catalog_pages.product_links(links, path="/[a-z]*(?:er|th)[a-z]*(?:/|$)", hint="an|e").select("page_id", "ord", "url", "link_text")
