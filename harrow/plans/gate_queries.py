"""Queries of both gates, enrichment, application destinations, name lookups with groups, keys, public tables and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import text as tx
from harrow.functions import urls
from harrow.operators import gate, health, match, merge, products
from harrow.plans.notice_queries import _query
from harrow.plans.queries import _SQL_NORM, QUERIES
from harrow.session import table

_KINDS = ("manual", "aggregated", "x", "web", "intelligence")


@_query(
    """with o as (select o_orderkey as k, o_custkey as c, o_orderdate::date as d, p_partkey, p_name, p_size from orders left join part on o_orderkey % 3000 = p_partkey),
    f as (select *, k % 5 as kind, k % 5 = 0 as manual, k % 58 = 0 as notice, k % 5 in (1, 2, 4) as intel, k % 5 in (1, 4) as agg, case when k % 17 = 0 then '' when k % 13 = 0 then 'x.com' when k % 11 = 0 then 'sub.blocked.example' else 'shop' || (k % 7) || '.example.jp' end as host,
        case when k % 19 = 0 then 'shop' || (k % 7) || '.example.jp' else 'list.example.jp' end as source_host, case when k % 23 = 0 then null else d + (k % 9 - 1)::int end as e, k % 31 <> 0 as has_shop, k % 37 <> 0 as has_result, (k % 10) / 10.0 as conf,
        case when k % 10 < 9 then k % 4 <> 0 else false end as ok, p_partkey is not null as known, '2000-0' || (1 + p_partkey % 9) || '-15' as release from o),
    v as (select *, notice or (intel and ok) or not intel as checked, host = 'sub.blocked.example' as blocked from f),
    r as (select *, list_filter([case when not known then 'catalog' end, case when e is null then 'deadline' end, case when e < d then 'order' end, case when e + interval 86399 second - interval 9 hour < timestamp '2000-05-01' - interval 35 day then 'expired' end,
        case when e + interval 86399 second - interval 9 hour > timestamp '2000-05-01' + interval 365 day then 'far' end, case when host = '' then 'no_host' end, case when blocked then 'blocked' end, case when not notice and ((agg and host = source_host) or blocked or host = 'x.com') then 'not_direct' end,
        case when agg and not notice and not checked then 'unverified' end], lambda x: x is not null) as why from v),
    s as (select *, has_shop and e is not null and has_result as complete, case when len(why) > 0 and conf < 0.8 and k % 6 = 0 then greatest(conf, 0.9) else conf end as sure, len(list_filter(why, lambda w: w in ('expired', 'far', 'order'))) > 0 as hard from r),
    t as (select *, case when manual then case when complete then 'published' else 'review' end when len(why) = 0 then 'published' when hard then 'rejected' else 'review' end as status from s)
    select k, status, case when known then p_name else 'n' || c end as product, p_partkey as "productCatalogId", case when manual then case when complete then '' else 'incomplete' end else array_to_string(why, ',') end as reasons,
    round(case when manual and complete then 0.99 when status = 'published' then greatest(0.86, sure) else sure end, 2)::double as confidence, case when not manual then checked end as "destinationVerified", known as "catalogMatched",
    not manual and checked and host <> '' and not blocked and not list_contains(why, 'not_direct') as "directVerified",
    case when known and not manual and k % 41 <> 0 and (not has_result or release >= strftime(d + 12, '%Y-%m-%d')) then release else '' end as purchase_start from t"""
)
def decided_candidates(spark, sf):
    k = F.col("o_orderkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    date = F.to_date("o_orderdate")
    url = F.when(k % 17 == 0, "bad").when(k % 13 == 0, "https://x.com/p").when(k % 11 == 0, F.concat(F.lit("https://sub.blocked.example/"), k.cast("string"))).otherwise(F.concat(F.lit("https://shop"), (k % 7).cast("string"), F.lit(".example.jp/e")))
    rows = table(spark, sf, "orders").select(
        k.alias("key"), F.element_at(F.array(*map(F.lit, _KINDS)), (k % 5 + 1).cast("int")).alias("sourceKind"), F.lit(None).cast("boolean").alias("manualEntry"), (k % 29 == 0).alias("noticeOnly"), (k % 58 == 0).alias("officialAccount"), F.lit(False).alias("officialNotice"),
        F.when(k % 31 != 0, "shop").otherwise("").alias("shop"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("product"), day(date).alias("applyStartDate"), F.when(k % 23 != 0, day(F.date_add(date, (k % 9 - 1).cast("int")))).alias("applyEndDate"),
        F.when(k % 37 != 0, day(F.date_add(date, 12))).otherwise("").alias("resultStartDate"), F.lit("").alias("purchaseStartDate"), F.lit("").alias("purchaseEndDate"), F.lit("").alias("rawApplyText"), url.alias("url"),
        F.when(k % 19 == 0, F.concat(F.lit("https://shop"), (k % 7).cast("string"), F.lit(".example.jp/list"))).otherwise("https://list.example.jp/").alias("sourceUrl"), F.lit(True).alias("purchasePolicy"), F.when(k % 41 == 0, "再販の分").otherwise("x").alias("context"), ((k % 10) / 10).alias("confidence"),
    )
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("catalog_id"), F.col("p_name").alias("catalog_name"), F.concat(F.lit("2000-0"), (1 + F.col("p_partkey") % 9).cast("string"), F.lit("-15")).alias("release"))
    matches = rows.select("key", (F.col("key") % 3000).alias("catalog_id")).join(part, "catalog_id")
    verified = rows.where("key % 10 < 9").select("key", (F.col("key") % 4 != 0).alias("ok"))
    votes = rows.select("key", (F.col("key") % 6 == 0).alias("accepted"), F.lit(0.9).alias("confidence"))
    done = gate.decide(rows, matches, verified, F.lit("2000-05-01").cast("timestamp"), ["blocked.example"], votes)
    return done.select(
        F.col("key").alias("k"), "status", "product", "productCatalogId", F.array_join("reasons", ",").alias("reasons"), F.round("confidence", 2).alias("confidence"), "destinationVerified", "catalogMatched", "directVerified", F.coalesce("purchaseStartDate", F.lit("")).alias("purchase_start")
    )


@_query(
    """with r as (select p_partkey as k, 'https://t.livepocket.jp/e/slug' || p_partkey as at, p_size from part where p_partkey % 3 = 0)
    select o_orderkey as k, case when r.k is not null and p_size % 2 = 0 then 'read ' || r.k else 'own' end as shop, case when r.k is not null and p_size % 5 <> 0 then '大阪府' else '北海道' end as area, case when r.k is not null then 'a' || chr(10) || 'b' else 'a' end as memo,
    'id' || o_orderkey as "externalId", case when r.k is not null then greatest((o_custkey % 10) / 10, p_size / 50, 0.9) else (o_custkey % 10) / 10 end::double as confidence, r.k is not null as enriched
    from orders left join r on r.k = o_orderkey % 500 and o_orderkey % 4 <> 0"""
)
def enriched_items(spark, sf):
    k = F.col("o_orderkey")
    at = lambda n: F.concat(F.lit("https://www.livepocket.jp/e/Slug"), n.cast("string"), F.lit("?utm_source=x"))
    items = table(spark, sf, "orders").select(
        k.alias("k"), F.when(k % 4 != 0, at(k % 500)).otherwise(F.concat(F.lit("https://shop.example.jp/"), k.cast("string"))).alias("url"), F.lit("own").alias("shop"), F.lit("北海道").alias("area"), F.lit("a").alias("memo"),
        F.concat(F.lit("id"), k.cast("string")).alias("externalId"), ((F.col("o_custkey") % 10) / 10).alias("confidence"),
    )
    p, size = F.col("p_partkey"), F.col("p_size")
    read = lambda n, shop: table(spark, sf, "part").where("p_partkey % 3 = 0").select(
        F.concat(F.lit("https://livepocket.jp/e/slug"), p.cast("string")).alias("url"), F.lit(n).alias("ord"), shop.alias("shop"), F.when(size % 5 != 0, "大阪府").otherwise("全国").alias("area"), F.lit("b").alias("memo"), F.lit("other").alias("externalId"), (size / 50).alias("confidence")
    )
    readings = read(1, F.when(size % 2 == 0, F.concat(F.lit("read "), p.cast("string"))).otherwise("")).unionByName(read(2, F.lit("second")))
    return merge.enrich_applications(items, readings).select("k", "shop", "area", "memo", "externalId", "confidence", "enriched")


_SHOPS = ("ゲオ青店", "ブックオフ緑店", "ふるいち赤店", "よろず屋")


@_query(
    """with c as (select c_custkey as k, c_custkey % 4 as shop, c_custkey % 3 as named, c_custkey % 5 = 0 as said, c_custkey % 7 = 0 as opens from customer),
    i as (select *, ['geo', 'bookoff', 'furuichi', null][(shop + 1)::int] as own, case named when 0 then 'geo' when 1 then null else 'bookoff' end as declared from c),
    r as (select *, coalesce(declared is not null and case when own is not null then declared <> own else not opens end, false) as repaired from i),
    w as (select *, case when repaired then null else declared end as app, opens and not repaired as link from r),
    f as (select *, said or app is not null or link as wants, coalesce(app, own) as profile from w)
    select k, repaired, case when wants then 'app' else 'direct' end as "destinationType", case when wants then coalesce(profile, '') else '' end as "appId",
    case when app = 'geo' then 'ゲオアプリ' when app = 'bookoff' then 'ブックオフ' when not wants then '' when profile = 'geo' then 'ゲオアプリ' when profile = 'bookoff' then 'ブックオフ公式アプリ' when profile = 'furuichi' then 'LINE（ふるいちアプリ）' else '応募アプリ' end as "appName",
    case when link then 'https://liff.line.me/' || k else '' end as "appUrl", case when not wants then '' when profile = 'geo' then 'https://apps.apple.com/jp/app/id590190880' when profile = 'bookoff' then 'https://apps.apple.com/jp/app/id1369113760' else '' end as "iosAppStoreUrl",
    case when not wants then '' when profile = 'geo' then 'https://apps.apple.com/jp/app/id590190880' when profile = 'bookoff' then 'https://apps.apple.com/jp/app/id1369113760' when profile = 'furuichi' then 'https://www.furu1.net/point-card.html' else '' end as "fallbackUrl" from f"""
)
def app_destinations(spark, sf):
    k = F.col("c_custkey")
    none = F.lit("")
    rows = table(spark, sf, "customer").select(
        k.alias("k"), F.element_at(F.array(*map(F.lit, _SHOPS)), (k % 4 + 1).cast("int")).alias("shop"), F.lit("拡張パック").alias("product"), F.lit("https://shop.example.jp/p").alias("url"), none.alias("sourceUrl"), none.alias("fallbackUrl"),
        F.when(k % 5 == 0, "アプリから応募").otherwise("").alias("instructions"), none.alias("memo"), F.lit("direct").alias("destinationType"), none.alias("appId"), F.when(k % 3 == 0, "ゲオアプリ").when(k % 3 == 2, "ブックオフ").otherwise("").alias("appName"),
        F.when(k % 7 == 0, F.concat(F.lit("https://liff.line.me/"), k.cast("string"))).otherwise("").alias("appUrl"), none.alias("iosAppStoreUrl"), none.alias("androidAppStoreUrl"), none.alias("appOfficialUrl"),
    )
    return products.with_app_destination(rows).select("k", "repaired", "destinationType", "appId", "appName", "appUrl", "iosAppStoreUrl", "fallbackUrl")


@_query(
    f"""with v as (select distinct {_SQL_NORM("p_type || ' ' || p_name")} as t, false as generic from part union select distinct {_SQL_NORM("p_type")}, true from part), k as (select p_partkey as id, {_SQL_NORM("p_name")} as k from part union all select 1000000 + p_size, {_SQL_NORM("p_type")} from part where p_size <= 25),
    g as (select k, min(id) as id from k where id >= 1000000 group by k),
    s as (select t, id, k, case when t = k then 10000 + length(k) when length(k) >= 4 and contains(t, k) then 2000 + length(k) - 2 * abs(length(t) - length(k)) when length(t) >= 4 and contains(k, t) then 1000 + length(t) - 3 * abs(length(t) - length(k)) end as score from v, k where not generic and length(t) >= 3 and k <> '')
    select t as value, id, k as label, score::int as score, false as generic from (select *, row_number() over (partition by t order by score desc, id) as r from s where score is not null) where r = 1
    union all select t, id, t, 10000 + length(t), true from v join g on k = t where generic and length(t) >= 3"""
)
def generic_match(spark, sf):
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    part = table(spark, sf, "part")
    values = part.select(norm(F.concat_ws(" ", "p_type", "p_name")).alias("t"), F.lit(False).alias("generic")).unionByName(part.select(norm(F.col("p_type")).alias("t"), F.lit(True).alias("generic"))).distinct()
    labels = part.select(F.col("p_partkey").alias("id"), F.lit(0).alias("ordinal"), norm(F.col("p_name")).alias("key"), F.lit(False).alias("is_group"))
    groups = part.where("p_size <= 25").select((1_000_000 + F.col("p_size")).cast("long").alias("id"), F.lit(0).alias("ordinal"), norm(F.col("p_type")).alias("key"), F.lit(True).alias("is_group"))
    values = values.select(F.col("t").alias("value"), F.col("generic").alias("kind"), "t", "generic")
    found = match.best_match(values, "t", labels.unionByName(groups), row_cols=["value", "kind"], generic="generic")
    return found.select("value", "id", "label", "score", F.col("kind").alias("generic"))


@_query(
    """with d as (select doc_id, left(regexp_replace(text, '\\s+', ' ', 'g'), 60 + (doc_id % 100)::int) as name from documents), l as (select w as label, min(item_id) as id from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as w from benchmark) group by w),
    n as (select id, 'item ' || id as name from l group by id), hit as (select doc_id, id, row_number() over (partition by doc_id order by length(label) desc, id, label) as r from d join l on contains(lower(name), label) where length(name) >= 110)
    select d.doc_id, coalesce(n.name, d.name) as name from d left join hit on hit.doc_id = d.doc_id and r = 1 left join n on n.id = hit.id"""
)
def repaired_names(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.left(F.regexp_replace("text", r"\s+", " "), (60 + F.col("doc_id") % 100).cast("int")).alias("name"))
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    catalog = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), words.alias("label"))
    return match.repaired_names(docs, "name", F.lower("name"), F.length("name") >= 110, catalog)


_KEYED = "lower('ポケモンカード MEGA ' || p_name || ' BOX「抽選販売」1箱 &amp; https://a.example.jp/' || p_partkey || ' 再販')"
_KANA = "[^a-z0-9ぁ-んァ-ヶ一-龠]+"
_MARKED = "[\\s　「」『』【】\\[\\]()（）・･‐‑‒–—―_-]"


@_query(
    f"""with t as (select p_partkey, {_KEYED} as t from part), g as (select *, regexp_replace(regexp_replace(t, 'ポケモンカードゲーム|ポケモンカード|ポケカ', '', 'g'), '抽選販売|予約販売|招待リクエスト|応募受付|box|ボックス|1箱|一箱', '', 'g') as gate from t)
    select p_partkey, regexp_replace(gate, '{_KANA}', '', 'g') as gate, regexp_replace(gate, '{_KANA}', '', 'g') as dedupe, regexp_replace(regexp_replace(t, 'ポケモンカードゲーム|ポケモンカード|ポケカ|mega', '', 'g'), '{_KANA}', '', 'g') as groups,
    regexp_replace(regexp_replace(replace(t, '&amp;', '&'), '{_MARKED}', '', 'g'), '抽選販売|抽選受付|予約販売|応募フォーム|再販', '', 'g') as catalog, regexp_replace(regexp_replace(t, 'https?://\\S+', '', 'g'), '{_MARKED}', '', 'g') as identity, regexp_replace(t, '{_KANA}', '', 'g') as destination from g"""
)
def name_keys(spark, sf):
    name = F.concat(F.lit("ポケモンカード MEGA "), "p_name", F.lit(" BOX「抽選販売」1箱 &amp; https://a.example.jp/"), F.col("p_partkey").cast("string"), F.lit(" 再販"))
    rows = table(spark, sf, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", *[tx.key_of(F.col("name"), kind).alias(kind) for kind in tx.NORMALISERS])


@_query(
    """select 'feed' as kind, o_orderkey as k from orders where o_orderkey % 11 <> 0 union all select 'store', s_suppkey from supplier union all select 'product', p_partkey from part"""
)
def public_rows(spark, sf):
    from harrow.sources.tables import public_tables

    k = F.col("o_orderkey")
    host = F.when(k % 22 == 0, "https://sub.blocked.example/").when(k % 11 == 0, "https://www.Blocked.example/").when(k % 5 == 0, "no address").otherwise("https://unblocked.example/")
    feed = table(spark, sf, "orders").select(k.alias("k"), host.alias("url"), F.lit("s").alias("sourceUrl"), F.lit(1).alias("xPostId"))
    stores = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("n").alias("sourceName"))
    goods = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.lit("n").alias("lastSeenAt"), F.lit("n").alias("source"))
    shown = public_tables(feed, stores, goods, ["blocked.example"])
    # what is private is gone: only the columns that all share are left to select by place
    return shown["feed"].drop("url").select(F.lit("feed").alias("kind"), "*").union(shown["stores"].select(F.lit("store"), "*")).union(shown["products"].select(F.lit("product"), "*"))


@_query(
    """with r as (select s_nationkey as n, s_name as name, s_suppkey % 3 <> 0 as ok, case when s_suppkey % 2 = 0 then 'warning' else 'error' end as severity, 'HTTP ' || s_suppkey as error, s_suppkey % 4 as items, s_suppkey % 5 as pages from supplier),
    g as (select n, count(*) as checked, count(*) filter (ok) as ok, count(*) filter (not ok) as failed, count(*) filter (not ok and severity = 'error') as errors, coalesce(string_agg(severity || ' ' || case when severity = 'error' then '取得元エラー: ' else '取得元警告: ' end || name || ' ' || error, '|' order by name) filter (not ok), '') as notes,
        '| source | state | pages | items |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || name || ' | ' || case when ok and items > 0 then '✅' when not ok and severity = 'error' then '❌' else '⚠️' end || ' | ' || pages || ' | ' || items || ' |', chr(10) order by name) as tab from r group by n),
    s as (select n_nationkey as n, ['ok', 'search_failed', 'no_candidates', 'ok'][(n_nationkey % 4 + 1)::int] as status from nation where n_nationkey < 20)
    select g.n, case when errors > 0 or ok = 0 or status = 'search_failed' then 'error' when failed > errors or status = 'no_candidates' then 'warning' else 'ok' end as level, case when errors > 0 or ok = 0 or coalesce(status, '') = 'search_failed' then 1 else 0 end as exit_code, checked, ok, failed, notes, sha256(tab) as table_sha256 from g left join s using (n)"""
)
def health_reports(spark, sf):
    k = F.col("s_suppkey")
    results = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("n"), F.col("s_name").alias("name"), (k % 3 != 0).alias("ok"), F.when(k % 2 == 0, "warning").otherwise("error").alias("severity"), F.concat(F.lit("HTTP "), k.cast("string")).alias("error"), (k % 4).alias("items"), (k % 5).alias("pages")
    )
    searches = table(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("n"), F.element_at(F.array(*map(F.lit, ("ok", "search_failed", "no_candidates", "ok"))), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("status"))
    told = health.health_report(results, searches, ["n"])
    notes = F.array_join(F.transform("annotations", lambda a: F.concat_ws(" ", a["level"], a["title"], a["message"])), "|")
    return told.select("n", "level", "exit_code", "checked", "ok", "failed", notes.alias("notes"), F.sha2("table", 256).alias("table_sha256"))


def standard_urls(spark, sf):
    """Addresses with other letters made of the documents' words, as the URL standard writes them; brute force in the tests."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?U)\w+"), F.lit(0))
    rows = table(spark, sf, "documents").select("doc_id", F.filter(words, lambda w: F.length(w) < 40).alias("w")).where("size(w) > 5")
    address = F.concat(F.lit(" HTTP://"), F.col("w")[0], F.lit(".Example.org:80/a/./"), F.col("w")[1], F.lit("/%2E%2e/"), F.col("w")[2], F.lit("/x y?q="), F.col("w")[3], F.lit("'<#"), F.col("w")[4], F.lit("`\t"))
    made = rows.select("doc_id", address.alias("raw"))
    return made.select("doc_id", "raw", urls.standard_url(F.col("raw")).alias("url"), urls.canonical_url(F.col("raw"), urls.UrlPolicy(drop="q$", standard=True)).alias("canonical"))


QUERIES["standard_urls"] = standard_urls
