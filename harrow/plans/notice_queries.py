"""Queries of the notice layouts and of other readers: every order (or part) makes a page, and SQL says from its columns what is to be read.

The sale of an order: it begins on a day s from 2025-11-02 on, ends on e, tells its winners on r, and sells from p to q. What pages
hold varies with the order's number k and its customer c.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import notices
from harrow.plans.queries import ORACLES, QUERIES
from harrow.session import spread, table

BASE = "2026-01-01"
DAYS = {"s": 0, "e": 3, "r": 7, "p": 9, "q": 11}
SALES = "o as (select o_orderkey as k, o_custkey as c, date '2025-11-02' + ((o_orderkey * 7) % 240)::int as s from orders), d as (select *, " + ", ".join(f"s + {n} as {c}" for c, n in DAYS.items() if n) + " from o)"


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """k, c and the five days of each order's sale."""
    start = F.date_add(F.lit("2025-11-02").cast("date"), ((F.col("o_orderkey") * 7) % 240).cast("int"))
    rows = spread(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), start.alias("s")), "k")
    return rows.select("k", "c", *[F.date_add("s", n).alias(c) for c, n in DAYS.items()])


#: How a day is written behind its column's name: e for 7月5日, e+ for 2026年7月5日, e/ for 7/5, e- for a year too early.
_WRITTEN = {"": "M月d日", "+": "yyyy年M月d日", "/": "M/d"}


def _piece(name: str) -> Column:
    if name in ("k", "c"):
        return F.col(name).cast("string")
    day, kind = name[0], name[1:]
    return F.date_format(F.add_months(F.col(day), -12), _WRITTEN["+"]) if kind == "-" else F.date_format(day, _WRITTEN[kind])


def page(*parts: str | tuple[Column, str]) -> Column:
    """Text with {names} filled in; a part with a condition comes only where it holds."""

    def filled(text: str) -> Column:
        return F.concat(*[F.lit(t) if i % 2 == 0 else _piece(t) for i, t in enumerate(re.split(r"\{([^}]+)\}", text))])

    return F.concat(*[filled(p) if isinstance(p, str) else F.when(p[0], filled(p[1])).otherwise("") for p in parts])


def every(n: int, of: int = 0, column: str = "k") -> Column:
    return F.col(column) % n == of


def _select(parser: str, rows: str, **given: str) -> str:
    """SQL of records; `rows` is a FROM clause over d, `given` what differs from a plain direct one."""
    day = lambda c: f"strftime({c}, '%Y-%m-%d')"
    known = {
        "source_url": "'https://shop.example.jp/p' || k", "page_id": "k", "shop": "'shop.example.jp'", "area": "'全国'", "product": "''", "url": "'https://shop.example.jp/p' || k", "applyStartDate": day("s"), "applyStartTime": "''", "applyEndDate": day("e"), "applyEndTime": "''", "resultStartDate": day("r"),
        "resultEndDate": "''", "purchaseStartDate": day("p"), "purchaseEndDate": day("q"), "destinationType": "'direct'", "noticeOnly": "false", "confidence": "0.99::double", "verified": "true", "collectionMode": "'page'",
    } | given
    plain = f"select {', '.join(f'{v} as \"{c}\"' for c, v in known.items())} from {rows}"
    return f"select *, substr(sha256(concat_ws(chr(10), source_url, shop, product, \"applyEndDate\")), 1, 24) as \"externalId\" from ({plain})"


def _notices(name: str, layouts: tuple[str, ...], sql: str, make) -> None:
    """Registers a query: make() gives html, and optionally url, parser, keywords, as Columns by name, over the sales."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        given = {"url": page("https://shop.example.jp/p{k}"), **make()}
        pages = sales(spark, sf).select(F.col("k").alias("page_id"), *[v.alias(c) for c, v in given.items()])
        return notices.read_notices(pages, F.lit(BASE).cast("date"), layouts=layouts).select(*notices.RECORD)

    run.__name__ = name
    run.__doc__ = "A page for each order, read by the layout; see the module."
    QUERIES[name] = run
    ORACLES[name] = f"with {SALES} {sql}"


_SPAN = "<p>応募期間：{s+} 10:00～{e} 23:59</p>"
_TIMES = {"applyStartTime": "'10:00'", "applyEndTime": "'23:59'"}
_SOLD = "case when k % 4 = 0 then strftime({0}, '%Y-%m-%d') else '' end"
_PART_SOLD = {"purchaseStartDate": _SOLD.format("p"), "purchaseEndDate": _SOLD.format("q"), "confidence": "case when k % 4 = 0 then 0.99 else 0.98 end::double"}

_notices(
    "notice_books",
    ("rakuten-books",),
    _select("rakuten-books", "(select *, unnest(case when k % 7 = 0 then ['ポケモンカードゲームの抽選', '拡張パック N' || c] else ['拡張パック N' || c] end || case when k % 3 = 0 then ['ハイクラスパック M' || k] else [] end) as product from d)",
            product="product", url="case when k % 5 = 0 then 'https://shop.example.jp/entry?x=' || k else 'https://shop.example.jp/p' || k end", **_TIMES, **_PART_SOLD),
    lambda: {
        "parser": F.lit("rakuten-books"),
        "html": page("<h1>ポケモンカードゲームの抽選</h1>", (~every(7), "<p>対象商品：拡張パック N{c}</p>"), (every(7), "<p>拡張パック N{c}</p>"), (every(3), "<p>ハイクラスパック M{k}</p>"), _SPAN, "<p>当選発表：{r}</p>", (every(4), "<p>購入期間：{p}～{q}</p>"), (every(5), "<a href='/entry?x={k}'>エントリーする</a>")),
    },
)

_notices(
    "notice_goods",
    ("geo-lottery",),
    _select("geo-lottery", "(select *, unnest(case when k % 2 = 0 then ['スターターセットex 甲' || k || 'ex', 'スターターセットex 乙' || k || 'ex'] else [] end || ['拡張パック ソラ' || c] || case when k % 3 = 0 then ['スタートデッキ100 ツキ' || c] else [] end) as product from d)",
            product="'ポケモンカードゲーム MEGA ' || product", shop="'ゲオ'", url="'https://draw.example.jp/' || k", applyStartTime="'11:00'", applyEndTime="'17:59'", resultStartDate="''", purchaseEndDate="''", purchaseStartDate="case when k % 5 = 0 then '' else strftime(p, '%Y-%m-%d') end", confidence="0.95::double", collectionMode="'official-news-multi-product'"),
    lambda: {
        "parser": F.lit("geo-lottery"),
        "html": page("<h2>{p}に発売</h2><p>ポケモンカードゲーム MEGA 拡張パック「ソラ{c}」を扱います。</p>", (every(2), "<p>ポケモンカードゲーム MEGA スターターセットex「甲{k}ex／乙{k}ex」。</p>"), (every(3), "<p>ポケモンカードゲーム MEGA スタートデッキ100 ツキ{c}。</p>"), (every(5), "<p>再販売の分です。</p>"),
                     "<p>応募期間は{s/} 11:00 ～ {e/} 17:59。抽選販売です。</p><a href='https://draw.example.jp/{k}'>応募ページ</a>"),
    },
)

_EVENTS = "case when k % 3 = 0 then ['https://livepocket.jp/e/a' || k, 'https://livepocket.jp/e/b' || k] else ['https://livepocket.jp/e/a' || k] end"
_notices(
    "notice_pairs",
    ("hobby-station-news",),
    _select("hobby-station-news", f"""(select *, unnest(list_transform(range(1, greatest(len(ps), len(us)) + 1), lambda i: {{'product': ps[least(i, len(ps))], 'u': us[least(i, len(us))]}})) as x, year(e) - year(r) + 1 as gap
            from (select *, ['ポケモンカードゲーム MEGA 拡張パック ホシ' || k] || case when k % 2 = 0 then ['ハイクラスパック ツキ' || c] else [] end as ps, {_EVENTS} as us from d) where k % 11 <> 0)""",
            product="x.product", url="x.u", shop="'ホビーステーション'", resultStartDate="case when k % 4 <> 0 then strftime(r, '%Y-%m-%d') when gap = 1 then year(e) || strftime(r, '-%m-%d') else (year(r) - 1) || strftime(r, '-%m-%d') end", collectionMode="'official-news-livepocket'", **_TIMES),
    lambda: {
        "parser": F.lit("hobby-station-news"), "url": F.when(every(11), page("https://shop.example.jp/category/{k}")).otherwise(page("https://shop.example.jp/p{k}")),
        "html": page("<h2>ポケモンカードゲーム MEGA 拡張パック「ホシ{k}」の抽選</h2>", (every(2), "<p>「ハイクラスパック ツキ{c}」</p>"), "<a href='https://livepocket.jp/e/a{k}'>申し込む</a>", (every(3), "<a href='https://livepocket.jp/e/b{k}'>申し込む</a>"), _SPAN,
                     (~every(4), "<p>当選発表：{r+}</p>"), (every(4), "<p>当選発表：{r-}</p>"), "<p>当選者購入期間：{p+}～{q}</p><h3>最近の投稿</h3><p>「拡張パック ムカシ」</p>"),
    },
)

_notices(
    "notice_sections",
    ("furuichi-news", "amiami"),
    _select("furuichi-news", "(select *, unnest(case when k % 14 = 0 then [{'n': 3, 'name': 'ポケモンカードゲーム MEGA 拡張パック ソラ' || c}] else [{'n': 1, 'name': 'ポケモンカードゲーム MEGA 拡張パック ソラ' || c}] || case when k % 4 = 0 then [{'n': 2, 'name': 'ポケモンカードゲーム スタートデッキ100 ツキ' || k}] else [] end end) as x from d where k % 2 = 0)",
            shop="'ふるいち青' || c || '店'", product="x.name", url="case when k % 14 <> 0 and k % 10 = 0 then 'https://livepocket.jp/e/a' || k else 'https://shop.example.jp/p' || k end",
            noticeOnly="k % 14 <> 0 and k % 10 <> 0 and k % 6 = 0", destinationType="case when k % 14 = 0 then 'app' when k % 10 <> 0 and k % 6 = 0 then 'store' else 'direct' end",
            collectionMode="case when k % 14 = 0 then 'official-app-notice' when k % 10 <> 0 and k % 6 = 0 then 'official-store-qr-notice' else 'official-news-livepocket' end", **_TIMES)
    + " union all by name " + _select("amiami", "(select *, unnest([1, 2]) as n from d where k % 2 = 1)", product="case when n = 1 then '拡張パック ソラ' || c else 'ハイクラスパック ツキ' || k end", applyStartTime="'10:00'", applyEndTime="'23:59'",
            purchaseStartDate="case when n = 1 then '' else strftime(p, '%Y-%m-%d') end", purchaseEndDate="case when n = 1 then '' else strftime(q, '%Y-%m-%d') end", confidence="case when n = 1 then 0.98 else 0.99 end::double"),
    lambda: {
        "parser": F.when(every(2), "furuichi-news").otherwise("amiami"),
        "html": F.when(every(14), page("<h1>ふるいち青{c}店</h1><p>ふるいちアプリでWEB事前抽選</p><p>ポケモンカードゲーム MEGA 拡張パック ソラ{c}</p>", _SPAN, "<p>当選発表：{r+}</p><p>購入期間：{p+}～{q}</p>"))
        .when(every(2), page("<h1>ふるいち青{c}店</h1><h2>第1弾 LivePocket抽選販売</h2><p>ポケモンカードゲーム MEGA 拡張パック ソラ{c}</p>", _SPAN, "<p>当選発表：{r+}</p><p>購入期間：{p+}～{q}</p>", (every(6), "<p>店頭にQRがあります</p>"), (every(10), "<a href='https://livepocket.jp/e/a{k}'>応募</a>"),
                             (every(4), "<h2>第2弾 ライブポケット抽選販売</h2><p>ポケモンカードゲーム スタートデッキ100 ツキ{k}</p><p>応募期間：{s+} 1O:00～{e} 23:59</p><p>当選発表：{r+}</p><p>購入期間：{p+}～{q}</p>"), (every(6) & every(4), "<p>QRコードは店頭です</p>")))
        .otherwise(page("<p>【抽選販売】拡張パック ソラ{c}</p>", _SPAN, "<p>当選発表：{r}</p><p>【抽選販売】人形</p><p>応募期間：{s}～{e}</p><p>[抽選販売]カード</p><p>対象商品：ハイクラスパック ツキ{k}</p>", _SPAN, "<p>当選発表：{r}</p><p>販売期間：{p}～{q}</p>")),
    },
)

_PLACES = ("宮城県", "大阪府", "沖縄県")
_notices(
    "notice_event_page",
    ("livepocket",),
    _select("livepocket", "d", shop="'カードラボ青' || c || '店'", area="case when k % 4 = 0 then '全国' else ['宮城県', '大阪府', '沖縄県'][(k % 3 + 1)::int] end", product="'ポケモンカードゲーム MEGA 拡張パックソラ' || k", url="'https://livepocket.jp/e/z' || k", source_url="'https://livepocket.jp/e/z' || k",
            purchaseStartDate="''", purchaseEndDate="strftime(q, '%Y-%m-%d')", collectionMode="case when k % 2 = 0 then 'livepocket-public-search' else 'livepocket-direct' end", **_TIMES),
    lambda: {
        "parser": F.lit("livepocket"), "url": page("https://livepocket.jp/e/z{k}"), "is_child": every(2), "shop": F.lit(""),
        "html": page("<title>【カードラボ青{c}店】ポケモンカードゲーム MEGA 拡張パック「ソラ{k}」抽選販売</title>", *[(every(3, i) & ~every(4), f"<p>会場は{place}です</p>") for i, place in enumerate(_PLACES)], "<p>抽選のお知らせ 拡張パックについて</p><p>受付期間：{s+} 10:00～{e} 23:59</p><p>結果発表：{r}</p><p>受取期限：{q}まで</p>"),
    },
)

_notices(
    "notice_form",
    ("google-form",),
    _select("google-form", "d", shop="'トレカ広場' || c || '店'", product="'拡張パック ソラ' || k || '1BOX'", url="'https://docs.google.com/forms/d/e/' || k || '/viewform'", source_url="'https://docs.google.com/forms/d/e/' || k || '/viewform'", applyStartDate="''", applyEndTime="'20:00'", purchaseStartDate="''", purchaseEndDate="''", confidence="0.98::double", collectionMode="'google-form-direct'"),
    lambda: {
        "parser": F.lit("google-form"), "url": page("https://docs.google.com/forms/d/e/{k}/viewform"), "shop": F.lit(""),
        "html": page("<meta property='og:title' content='受付 {c} - Google フォーム'><p>トレカ広場{c}店</p><p>メールアドレス</p>", (every(2), "<p>対象商品：「拡張パック ソラ{k}」1BOX</p>"), (~every(2), "<p>対象商品</p><p>「拡張パック ソラ{k}」1BOX</p>"), "<p>応募締切 {e}20時まで</p><p>当選発表 {r}</p><p>氏名</p>"),
    },
)

_notices(
    "notice_listing",
    ("listing-intelligence-v1",),
    _select("listing-intelligence-v1", "(select *, unnest(case when k % 3 = 0 then [1, 2] else [1] end) as n from d)", product="case when n = 1 then '拡張パック ソラ' || c else 'ハイクラスパック ツキ' || k end", shop="case when n = 1 then '青' || c || '書店' else '緑の店' end",
            url="case when n = 1 then 'https://a.example.jp/apply/' || k else 'https://shop.example.jp/go/' || k end", applyStartDate="''", applyEndDate="case when n = 1 and k % 2 = 0 then '2026-01-02' else strftime(e, '%Y-%m-%d') end", applyEndTime="case when n = 1 and k % 2 = 0 then '23:30' else '' end",
            resultStartDate="''", purchaseStartDate="''", purchaseEndDate="''", confidence="0.64::double", verified="false", collectionMode="'aggregated'"),
    lambda: {
        "parser": F.lit("listing-intelligence-v1"),
        "html": page("<p>オンライン</p><p>拡張パック ソラ{c}</p><p>青{c}書店・ポケカ</p>", (every(2), "<p>明日 23:30 締切</p>"), (~every(2), "<p>{e}</p>"), "<a href='https://a.example.jp/apply/{k}'>応募ページへ</a>", (every(5), "<a href='https://a.example.jp/apply/{k}'>応募ページ</a>"),
                     (every(3), "<p>店頭</p><p>ハイクラスパック ツキ{k}</p><p>緑の店・ポケカ</p><p>{e/}</p><a href='/go/{k}'>抽選ページ</a>"), "<a href='/about'>運営</a>"),
    },
)

_notices(
    "notice_generic",
    ("generic", "geo-news", "livepocket-search", "hobby-search"),
    _select("generic", "(select *, unnest(['ポケモンカードの抽選', '拡張パック ソラ' || c]) as product from d where k % 6 in (0, 1))", product="product", purchaseStartDate="''", purchaseEndDate="''", confidence="0.98::double", **_TIMES)
    + " union all by name " + _select("hobby-search", "(select *, unnest(case when k % 4 = 0 then [1, 2] else [1] end) as n from d where k % 6 in (3, 4))", product="case when n = 1 then 'ポケモンカードゲーム 拡張パック ソラ' || c else 'ポケモンカードゲーム スタートデッキ ツキ' || k end", purchaseStartDate="''", purchaseEndDate="''", confidence="0.98::double", **_TIMES),
    lambda: {
        "parser": F.when(every(6), F.lit(None).cast("string")).when(every(6, 1), "geo-news").when(every(6, 2), "livepocket-search").when(every(6, 3) | every(6, 4), "hobby-search").otherwise("unknown"),
        "keywords": F.when(every(6, 5), F.array().cast("array<string>")).otherwise(F.array(F.lit("ポケモンカード"), F.lit("抽選"))),
        "html": F.when(every(6, 3) | every(6, 4), page("<h1>抽選</h1><p>ポケモンカードゲーム 拡張パック ソラ{c}</p>", _SPAN, "<p>当選発表：{r}</p>", (every(4), "<p>ポケモンカードゲーム スタートデッキ ツキ{k}</p>"), (every(4), _SPAN), "<p>x</p>" * 12 + "<p>ポケモンカードゲーム BOX 案内</p>"))
        .otherwise(page("<p>ポケモンカードの抽選</p><p>拡張パック ソラ{c}</p>", _SPAN, "<p>当選発表：{r}</p>")),
    },
)


_DISPATCHED = "case when k % 3 = 0 then [1] when k % 3 = 1 then [1, 2] else [] end"
_notices(
    "japanese_records",
    ("rakuten-books", "amiami", "generic"),
    _select("any", f"(select *, unnest({_DISPATCHED}) as n from d)", product="case when n = 1 then '拡張パック ソラ' || c else 'ハイクラスパック ツキ' || k end", purchaseStartDate="''", purchaseEndDate="''", confidence="0.98::double", **_TIMES),
    lambda: {
        "parser": F.when(every(3), "rakuten-books").when(every(3, 1), "amiami"),
        "html": page((every(3), "<h1>ポケモンカードゲームの抽選</h1><p>対象商品：拡張パック ソラ{c}</p>"), (~every(3), "<p>【抽選販売】拡張パック ソラ{c}</p>"), _SPAN, "<p>当選発表：{r}</p>", (every(3, 1), "<p>【抽選販売】ハイクラスパック ツキ{k}</p>"), (every(3, 1), _SPAN + "<p>当選発表：{r}</p>")),
    },
)


# ---- other readers


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@_query(
    f"""with {SALES} select k, case when k % 5 in (0, 1, 3) then strftime(s, '%Y-%m-%d') end as start_date, case k % 5 when 0 then '10:00' when 3 then '15:00' when 1 then '' end as start_time,
    case when k % 5 in (0, 1, 2) then strftime(e, '%Y-%m-%d') end as end_date, case k % 5 when 0 then '23:59' when 1 then '' when 2 then '' end as end_time from d"""
)
def japanese_dates(spark: SparkSession, sf: str) -> DataFrame:
    from harrow.functions import dates

    texts = page((every(5), "応募期間：{s}(土) 10:00〜{e} 23:59"), (every(5, 1), "受付 {s/}〜{e/}"), (every(5, 2), "{e+}まで"), (every(5, 3), "当選発表 {s} 午後3時"), (every(5, 4), "なし {k}"))
    found = sales(spark, sf).select("k", dates.date_range(texts, F.lit(BASE).cast("date")).alias("r"))
    return found.select("k", F.col("r.start.date").alias("start_date"), F.col("r.start.time").alias("start_time"), F.col("r.end.date").alias("end_date"), F.col("r.end.time").alias("end_time"))


def _hex(value: Column, digits: int, little: bool = False) -> Column:
    plain = F.lpad(F.hex(value.cast("long")), digits, "0")
    return F.concat(*[F.substring(plain, i + 1, 2) for i in range(digits - 2, -1, -2)]) if little else plain


@_query(
    """select p_partkey, kind, case when kind is not null then w end::int as width, case when kind is not null then h end::int as height, kind is not null and n >= 4000 and w >= 120 and h >= 120 as valid
    from (select p_partkey, [null, 'png', 'gif', 'jpeg', 'webp', 'webp', 'webp', 'svg', 'svg'][(p_partkey % 9 + 1)::int] as kind, 60 + p_size * 10 as w, 100 + p_partkey % 300 as h, case when p_partkey % 4 = 0 then 900 else 5000 end as n from part)"""
)
def image_headers(spark: SparkSession, sf: str) -> DataFrame:
    from harrow.operators import parse

    k, w, h = F.col("p_partkey"), 60 + F.col("p_size") * 10, 100 + F.col("p_partkey") % 300
    riff = lambda chunk: F.concat(F.lit("524946460000000057454250"), F.lit(chunk))
    svg = lambda text: F.hex(text.cast("binary"))
    heads = [
        F.lit("00112233"), F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 8), _hex(h, 8)), F.concat(F.lit("474946383961"), _hex(w, 4, True), _hex(h, 4, True)),
        F.concat(F.lit("FFD8FFE00010" + "00" * 14 + "FFC0001108"), _hex(h, 4), _hex(w, 4), F.lit("03")), F.concat(riff("565038580A00000000000000"), _hex(w - 1, 6, True), _hex(h - 1, 6, True)),
        F.concat(riff("56503820000000000000009D012A"), _hex(w, 4, True), _hex(h, 4, True)), F.concat(riff("5650384C000000002F"), _hex((w - 1) + F.shiftleft((h - 1).cast("long"), 14), 8, True)),
        svg(F.concat(F.lit("<svg width='"), w.cast("string"), F.lit("' height='"), h.cast("string"), F.lit("'>"))), svg(F.concat(F.lit("<?xml?><svg viewBox='0 0 "), w.cast("string"), F.lit(".5 "), h.cast("string"), F.lit("'>"))),
    ]
    head = F.element_at(F.array(*heads), (k % 9 + 1).cast("int"))
    content = F.concat(F.unhex(head), F.unhex(F.repeat(F.lit("00"), F.when(k % 4 == 0, 900).otherwise(5000) - F.floor(F.length(head) / 2).cast("int"))))
    found = table(spark, sf, "part").select("p_partkey", content.alias("content")).withColumn("i", parse.image_info(F.col("content")))
    return found.select("p_partkey", "i.kind", "i.width", "i.height", parse.image_valid(F.col("content"), F.col("i")).alias("valid"))


@_query(
    f"""with {SALES} select k, case when k % 5 = 0 then '' else 'ブックオフ青' || c || '店' end as shop, case when k % 4 = 0 then '拡張パック ソラ' || c else 'ソラ' || k || 'BOX' end as product, case when k % 5 <> 0 and k % 2 = 0 then '大阪府' else '全国' end as area,
    case when k % 5 = 0 then '通販' else '店舗' end as kind, case when k % 7 = 0 then '' else strftime(s, '%Y-%m-%d') end as apply_start, case when k % 7 = 0 then '' else '10:00' end as apply_start_time, strftime(e, '%Y-%m-%d') as apply_end, case when k % 7 = 0 then '' else '23:59' end as apply_end_time,
    strftime(r, '%Y-%m-%d') as result, case when k % 2 = 0 then strftime(p, '%Y-%m-%d') else '' end as purchase_start, strftime(q, '%Y-%m-%d') as purchase_end,
    round((case when k % 5 = 0 then 4 else 5 end + case when k % 2 = 0 then 1 else 0 end) / 6, 6) as confidence from d"""
)
def screen_texts(spark: SparkSession, sf: str) -> DataFrame:
    from harrow.operators import screen_text

    odd = F.translate(F.date_format("r", "yyyy/MM/dd"), "01", "Ol")  # as a recogniser may read it
    lines = page(
        (~every(5), "抽選 ブックオフ青{c}店 で\n"), (every(2), "大阪府\n"), "対象「ソラ{k}BOX」\n", (~every(7), "応募期間：{s+}（土） 10時〜{e} 23:59\n"), (every(7), "応募締切\n{e+}\n"), "注意事項 4月1日\n当選発表\n", (~every(3), "{r+}"),
    )
    text = F.concat(lines, F.when(every(3), odd).otherwise(""), page((every(4), "\n拡張パック ソラ{c}"), (every(2), "\n購入期間 {p+}〜{q}"), (~every(2), "\n受取期限 {q+}まで")))
    catalog = sales(spark, sf).select(F.col("c").alias("id"), F.concat(F.lit("拡張パック ソラ"), F.col("c").cast("string")).alias("label"))
    read = screen_text.read_screens(sales(spark, sf).select("k", text.alias("raw")), "raw", F.lit(2025), catalog)
    return read.select(
        "k", "shop", "product", "area", "kind", F.col("apply.start").alias("apply_start"), F.col("apply.startTime").alias("apply_start_time"), F.col("apply.end").alias("apply_end"), F.col("apply.endTime").alias("apply_end_time"),
        F.col("result.start").alias("result"), F.col("purchase.start").alias("purchase_start"), F.col("purchase.end").alias("purchase_end"), F.round("confidence", 6).alias("confidence"),
    )


_RELEASED = "date '2026-01-05' + ((p_partkey * 5) % 350)::int"
_PRODUCT_SQL = f"""with r as (select p_partkey as k, {_RELEASED} as day, 100 + p_size as price from part),
    y as (select *, case when k % 5 = 0 or month(day) >= 5 then 2026 else 2027 end || strftime(day, '-%m-%d') as written from r)"""


@_query(
    _PRODUCT_SQL
    + """ select k as page_id, '拡張パック ソラ' || k as name, '拡張パック' as category, written as "releaseDate", price::int as "priceYen", case when k % 3 <> 0 then 'https://maker.example.jp/img/product/' || k || '.png' when k % 7 = 0 then 'https://maker.example.jp/img/b' || k || '.png' else '' end as "imageUrl",
    case when k % 2 = 0 then 'https://maker.example.jp/products/' || k else '' end as "officialUrl" from y
    union all select k, 'スターターセットex ツキ' || k, '構築デッキ', written, price::int, 'https://maker.example.jp/img/b' || k || '.png', '' from y where k % 7 = 0"""
)
def product_pages(spark: SparkSession, sf: str) -> DataFrame:
    from harrow.operators import catalog_pages

    day = F.date_add(F.lit("2026-01-05").cast("date"), ((F.col("p_partkey") * 5) % 350).cast("int"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (100 + F.col("p_size")).alias("c"), day.alias("s"))
    parts = spread(parts, "k")
    html = page(
        "<h1>ご案内</h1><img src='https://cdn.example.org/product/{k}.png' alt='拡張パック「ヨソ{k}」'>", (every(2), "<p><a href='/products/{k}'>拡張パック「ソラ{k}」 {s}(金)発売</a></p>"), (~every(2), "<p>拡張パック「ソラ{k}」 {s}(金)発売</p>"),
        (~every(3), "<img data-src='/img/product/{k}.png' alt='拡張パック「ソラ{k}」'>"), (every(7), "<img src='/img/b{k}.png' alt='スターターセットex「ツキ{k}」'>"), "<p>希望小売価格 {c}円</p><p>拡張パック柄のデッキケース</p>",
    )
    url = F.when(every(5), page("https://maker.example.jp/2026/p{k}")).otherwise(page("https://maker.example.jp/p{k}"))
    return catalog_pages.page_products(parts.select(F.col("k").alias("page_id"), url.alias("url"), html.alias("html")), F.lit("2026-11-18").cast("date"))


@_query("select p_partkey, case when p_size % 3 = 0 then '拡張パック ' || p_name || '|' || p_name when p_size % 3 = 1 then 'スターターセットex ' || p_name || '|' || p_name else p_name end as aliases from part")
def product_aliases(spark: SparkSession, sf: str) -> DataFrame:
    from harrow.operators import catalog_pages

    kind = F.when(F.col("p_size") % 3 == 0, "拡張パック ").when(F.col("p_size") % 3 == 1, "スターターセットex ").otherwise("")
    named = table(spark, sf, "part").select("p_partkey", F.concat(kind, F.col("p_name")).alias("name"))
    return named.select("p_partkey", F.array_join(catalog_pages.aliases(F.col("name")), "|").alias("aliases"))
