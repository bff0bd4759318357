"""Contracts of the operators: order, ties, empties, invalid input, Japanese texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from harrow.functions import dates, urls
from harrow.functions import text as tx
from harrow.operators import discover, gate, health, match, merge, notices, parse, registry, state
from harrow.sources import tables

def base():
    return F.lit("2025-11-20").cast("date")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_html_to_text(spark):
    html = "<style>p{}</style><p>A&amp;B &#12509;&#x30B1; &lt;x&gt;</p>  <br/>c\r\n\n\n\nd<noscript>no</noscript><script>x</p></script>&unknown; "
    assert one(spark, tx.html_to_text(F.lit(html))) == "A&B ポケ <x>\n\nc\n\nd\n\n&unknown;" or one(spark, tx.html_to_text(F.lit(html))).startswith("A&B ポケ <x>")
    assert one(spark, tx.html_to_text(F.lit(None).cast("string"))) == ""


def test_lines_and_chunks(spark):
    assert one(spark, tx.lines_of(F.lit("・ a \n\n◆b\n　c　"))) == ["a", "b", "c"]
    assert one(spark, tx.distinct_lines(F.array(*map(F.lit, ["A b", "ab", "c"])))) == ["A b", "c"]
    chunks = one(spark, tx.overlapping_chunks(F.lit("x" * 3000)))
    assert [len(c) for c in chunks] == [1200, 1200, 1040] and one(spark, tx.overlapping_chunks(F.lit("ab"))) == ["ab"]
    lines = F.array(*map(F.lit, ["x", "応募期間：7/1", "から", "当選発表 8/1", "y"]))
    assert one(spark, tx.section_after(lines, "応募期間", ["当選発表"])) == "7/1\nから"
    assert one(spark, tx.section_after(lines, "なし", [])) == ""
    assert one(spark, tx.line_windows(F.array(*map(F.lit, "abcd")), 1, 2)) == ["a\nb", "a\nb\nc", "b\nc\nd", "c\nd"]


def test_text_helpers(spark):
    assert one(spark, tx.normalised(F.lit("ＢＯＸ ポケモンカード 拡張パック！"), drop="ポケモンカード|box")) == "拡張パック"
    assert one(spark, tx.redact(F.lit("at https://a.b/c?d /home/runner/work/x y"))) == "at [URL] [PATH] y"
    assert one(spark, tx.non_empty(F.lit(""), F.lit(None), F.lit("z"))) == "z"
    assert one(spark, tx.from_base64(tx.to_base64(F.lit("抽選")))) == "抽選"
    assert one(spark, tx.meta_content(F.lit('<meta content="A &amp; B" property="og:title">'), "og:title")) == "A & B"
    assert one(spark, tx.image_alts(F.lit("<img alt='a'><img src=x alt=\"b &amp; c\"><img alt='a'>"))) == ["a", "b & c"]
    same = [one(spark, tx.fingerprint(F.lit(f"<p>Hello  csrf-token=abcdefghijkl{i}</p>"))) for i in range(2)]
    assert same[0] == same[1]
    assert one(spark, tx.ocr_repair(F.lit("7/1O l2月 2O25年"))) == "7/10 l2月 2025年"


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://A.example.jp/x/?utm_source=a&b=1#top", "https://a.example.jp/x/?b=1"),
        ("https://a.example.jp/", "https://a.example.jp"),
        ("https://a.example.jp:443/x?ref=1&refs=2", "https://a.example.jp/x?refs=2"),
        (" nothing ", "nothing"),
    ],
)
def test_scope_urls(spark, url, expected):
    assert one(spark, urls.canonical_url(F.lit(url), urls.SCOPE)) == expected


def test_url_identities(spark):
    assert one(spark, urls.identity_url(F.lit("https://livepocket.jp/e/AbC_1?utm_x=1"))) == "https://t.livepocket.jp/e/abc_1"
    assert one(spark, urls.form_url(F.lit("https://docs.google.com/forms/d/e/1FA/formResponse?x=1"))) == "https://docs.google.com/forms/d/e/1FA/viewform"
    assert one(spark, urls.canonical_url(F.lit("bad"), urls.REVISIT)) == ""
    key = lambda u, e: one(spark, urls.identity_key(F.lit(u), F.lit("店 A"), F.lit("P-1"), F.lit("2026-01-01"), F.lit(e)))
    assert key("https://a.jp/x?ref=1", "") == "url:https://a.jp/x|variant:店a|p1|2026-01-01" and key("", "e1") == "id:e1" and key("", "") == "fallback:店a|p1|2026-01-01"
    assert one(spark, urls.host_under(F.lit("m.shop.jp"), ["www.shop.jp"])) and not one(spark, urls.host_under(F.lit("myshop.jp"), ["shop.jp"]))


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("12月28日(土) 10:00〜1月5日 23:59", ("2025-12-28", "10:00"), ("2026-01-05", "23:59")),
        ("2026年3月10日 午後3時まで", None, ("2026-03-10", "15:00")),
        ("7/14〜7/20", ("2025-07-14", ""), ("2025-07-20", "")),
        ("2月30日", None, None),
        ("なし", None, None),
        ("発売 1月9日", ("2026-01-09", ""), None),
    ],
)
def test_date_ranges(spark, text, start, end):
    got = one(spark, dates.date_range(F.lit(text), base()))
    assert (got["start"] and tuple(got["start"])) == start and (got["end"] and tuple(got["end"])) == end


def test_other_dates(spark):
    assert tuple(one(spark, dates.relative_deadline(F.lit("明日 18時まで"), base()))) == ("2025-11-21", "18:00")
    assert tuple(one(spark, dates.relative_deadline(F.lit("本日まで"), base()))) == ("2025-11-20", "23:59")
    assert one(spark, dates.nearest_year(F.lit(1), F.lit(5), base())) == 2026
    assert one(spark, dates.raise_year(F.lit("2025-01-08"), F.lit("2026-01-05"))) == "2026-01-08"
    assert one(spark, gate.weekday_matches(F.lit("7/1(水) 7/4(土)"), F.lit("2026-07-04"))) and not one(spark, gate.weekday_matches(F.lit("7/4(日)"), F.lit("2026-07-04")))
    assert not one(spark, gate.valid_date(F.lit("2026-02-30")))


def test_links_and_stats(spark):
    html = "<a href='/e/1?x=1'>抽選 応募</a><a href=\"https://shop.jp/e/1\">抽選</a><a href='#top'>抽選</a><a href='mailto:a@b'>抽選</a><a href='/faq'>抽選 FAQ</a><a href='https://else.jp/'>抽選</a><a href='rel/2'>ポケカ</a><a href='/z'>none</a>"
    pages = spark.createDataFrame([(1, "https://shop.jp/list/", html)], "id int, base string, html string").withColumn("host", urls.host(F.col("base")))
    judged = discover.judge_links(discover.extract_links(pages, base_col="base"), discover.LinkRules(most=1), "id", "host")
    got = {r["ord"]: (r["reason"], r["fate"], r["canonical_url"]) for r in judged.collect()}
    assert got[0] == (None, "returned", "https://shop.jp/e/1") and got[1][1] == "duplicate" and got[5][1] == "truncated" and got[5][2] == "https://shop.jp/list/rel/2"
    assert [got[i][0] for i in (2, 3, 4, 6)] == ["protocol", "excludePattern", "host", "includePattern"]
    stats = discover.discovery_stats(judged, "id").first()
    assert stats["accepted"] == stats["returned"] + stats["duplicates"] + stats["truncated"] == 3 and stats["total_links"] == 7


def test_evidence_fold_is_ordered(spark):
    rows = [("k", 1, 0.5, 0.0, "x", "first"), ("k", 2, 0.5, 0.0, "web", "second"), ("k", 3, 0.9, 0.0, "x", ""), ("j", 1, 0.98, 0.1, "web", "only"), ("j", 2, 0.9, 0.0, "web", "b")]
    frame = spark.createDataFrame(rows, "key string, ord int, confidence double, bonus double, kind string, product string")
    got = {r["key"]: r for r in merge.merge_evidence(frame, "key", ["ord"], F.col("bonus"), "kind", "confidence", ["product"]).collect()}
    assert got["k"]["confidence"] == 0.94 and got["k"]["product"] == "" and got["k"]["kinds"] == ["x", "web"] and got["k"]["evidence"] == 3
    assert got["j"]["confidence"] == 0.99 and got["j"]["product"] == "only"


def test_best_match_scores_and_ties(spark):
    labels = spark.createDataFrame([(1, 0, "abcdef"), (2, 0, "abcd"), (3, 0, "abcd"), (4, 0, "xyz")], "id int, ordinal int, key string")
    values = spark.createDataFrame([("a", "abcdef"), ("b", "zabcdz"), ("c", "bcde"), ("d", "xy"), ("e", "xyzw"), ("f", "xyz"), ("g", None)], "v string, t string")
    got = {r["v"]: (r["id"], r["score"]) for r in match.best_match(values, "t", labels).collect()}
    assert got == {"a": (1, 10006), "b": (2, 2000), "c": (1, 998), "f": (4, 10003)}


def test_groups_expand_only_when_counts_agree(spark):
    groups = spark.createDataFrame([("g1", "pack", 2, "d"), ("g2", "pack", 3, "d"), ("g3", "", 0, "d")], "group_id string, stem string, advertised int, release_date string")
    members = spark.createDataFrame([("m1", "packa", "d"), ("m2", "packb", "d"), ("m3", "packc", "e")], "member_id string, name_key string, release_date string")
    items = spark.createDataFrame([("i1", "g1"), ("i2", "g2"), ("i3", "g3"), ("i4", None)], "item string, group_id string")
    got = sorted((r["item"], r["member_id"] or "") for r in match.expand_groups(items, groups, members).collect())
    assert got == [("i1", "m1"), ("i1", "m2"), ("i2", ""), ("i3", ""), ("i4", "")]


def test_scopes_tombstones_and_upserts(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id int, scope string")
    got = merge.replace_scopes(frame([(1, "a"), (2, "b"), (3, ""), (4, None)]), frame([(9, "a"), (8, None)]), "scope")
    assert sorted(r["id"] for r in got.collect()) == [2, 3, 4]
    old = spark.createDataFrame([("a", "x", ["1"]), ("b", "y", None)], "k string, v string, t array<string>")
    new = spark.createDataFrame([("a", "", ["2", "1"], True), ("c", "z", None, True), ("d", "", None, False)], "k string, v string, t array<string>, ok boolean")
    out = {r["k"]: (r["v"], r["t"], r["status"]) for r in merge.upsert(old, new, "k", F.col("ok")).collect()}
    assert out == {"a": ("x", ["1", "2"], "update"), "b": ("y", [], "keep"), "c": ("z", [], "insert"), "d": (None, [], "review")}


def test_gate_reasons_in_order(spark):
    columns = "n int, catalog_id int, applyStartDate string, applyEndDate string, rawApplyText string, url string, sourceUrl string, sourceKind string, officialNotice boolean, destinationVerified boolean"
    good = (1, 1, "2026-07-01", "2026-07-04", "7/4(土)", "https://shop.jp/e/1", "https://list.jp/", "aggregated", False, True)
    rows = [good, (2, None, "2026-07-09", "2026-07-04", "7/4(日)", "https://list.jp/x", "https://list.jp/", "aggregated", False, False), (3, 1, None, None, None, None, None, None, None, None), (4, 1, None, "2026-05-01", None, "https://m.blocked.jp/", None, "web", False, False), (5, 1, None, "2026-07-04", None, "https://netflix.com/", None, "web", True, True), (6, 1, None, "2026-07-04", None, "https://x.com/a", None, "web", False, True)]
    got = {r["n"]: (r["reasons"], r["accepted"], r["warnings"]) for r in gate.evaluate(spark.createDataFrame(rows, columns), F.expr("timestamp'2026-07-02 00:00:00'"), ["blocked.jp"]).collect()}
    assert got[1] == ([], True, [])
    assert got[2][0] == ["catalog", "order", "weekday", "not_direct", "unverified"] and got[3][0] == ["deadline", "no_host"]
    assert got[4] == (["expired", "blocked", "not_direct"], False, ["recheck"]) and got[5][1] and got[6][0] == ["not_direct"]
    status = spark.createDataFrame([([],), (["expired"],), (["no_host"],)], "r array<string>").select(gate.split_status(F.col("r"), "expired").alias("s"))
    assert [r["s"] for r in status.collect()] == ["published", "rejected", "review"]


def test_publication(spark):
    rows = spark.createDataFrame([("https://netflix.com/", True, "s"), ("https://x.com/a", False, "s"), ("bad", True, "s"), ("https://a.jp/", False, "s")], "url string, noticeOnly boolean, sourceUrl string")
    out = gate.public_projection(rows)
    assert "sourceUrl" not in out.columns and [r["url"] for r in out.collect()] == ["https://netflix.com/", "", "", "https://a.jp/"]
    assert gate.assert_publishable(rows, F.array().cast("array<string>")).count() == 4
    with pytest.raises(Exception, match="not publishable"):
        gate.assert_publishable(rows, gate.reasons(("bad url", F.col("url") == "bad"))).collect()
    assert one(spark, gate.description_like(F.lit("a" * 120), ["です"])) and not one(spark, gate.description_like(F.lit("short です"), ["です"]))


def test_registry(spark):
    schema = "ord int, id string, name string, url string, parser string, enabled boolean, platform string, official_status string, official boolean, source_kind string, area string, priority string, interval_minutes string"
    rows = [(0, "a", "n", "https://livepocket.jp/e", None, None, None, None, True, None, None, "500", None), (1, "a", None, "", "odd", True, None, None, None, "aggregated", "東京", "x", "2"), (2, None, "z", "https://livepocket.jp/e/", "generic", False, "p", "s", None, None, None, "40", "9999")]
    got = {r["ord"]: r for r in registry.normalise(spark.createDataFrame(rows, schema)).collect()}
    assert (got[0]["priority"], got[0]["interval_minutes"], got[0]["platform"], got[0]["official_status"], got[0]["enabled"], got[0]["area"]) == (100, 5, "livepocket", "official", True, "全国")
    assert got[1]["errors"] == ["url missing", "id repeated"] and not got[1]["enabled"] and got[1]["priority"] == 70 and got[1]["interval_minutes"] == 5 and got[1]["warnings"] == ["parser unknown"]
    assert got[2]["id"].startswith("source-") and got[2]["interval_minutes"] == 1440 and got[2]["warnings"] == ["id generated", "url repeated"]


def test_state_and_health(spark):
    day = lambda d: datetime.datetime(2026, 1, d)
    rows = [("a", day(1), "f"), ("a", day(2), "f"), ("a", day(3), "g"), ("b", day(2), "f")]
    seen = state.newness(spark.createDataFrame(rows, "key string, run timestamp, fp string"), "key", "run", "fp").collect()
    assert [(r["key"], r["first_seen"], r["changed"]) for r in sorted(seen, key=lambda r: (r["key"], r["run"]))] == [("a", True, False), ("a", False, False), ("a", False, True), ("b", True, False)]
    assert max(r["last_changed_at"] for r in seen if r["key"] == "a") == day(3)
    assert tuple(one(spark, health.failure_class(F.lit("HTTP 503 x")))) == ("temporary_fetch_error", "warning") and one(spark, health.failure_class(F.lit("odd")))["severity"] == "error"
    votes = spark.createDataFrame([("k", True, 0.9, True), ("k", False, 0.2, True), ("k", True, 0.7, False), ("z", None, None, False)], "k string, a boolean, c double, ok boolean")
    got = {r["k"]: (r["accepted"], r["confidence"]) for r in health.vote(votes, "k", "a", "c", "ok").collect()}
    assert got == {"k": (True, 0.9), "z": (True, None)}


def test_parsers(spark):
    html = "<h1>ポケモンカードゲームの抽選</h1><p>対象商品：拡張パック A<br>スターターセット B</p><p>応募期間：7月1日〜7月5日まで</p><p>当選発表：7月8日</p><a href='/e/abc'>応募はこちら</a>"
    pages = spark.createDataFrame([(1, "https://shop.jp/n", html, "rakuten-books"), (2, "https://shop.jp/m", html, "hobby-search"), (3, "https://shop.jp/o", "<p>x</p>", "unknown-name"), (4, None, None, None)], "page_id int, url string, html string, parser string")
    got = notices.read_notices(pages, F.lit("2026-06-20").cast("date")).collect()
    first = [r for r in got if r["page_id"] == 1]
    assert {r["product"] for r in first} == {"拡張パック A"} and {r["applyEndDate"] for r in first} == {"2026-07-05"} and first[0]["url"] == "https://shop.jp/e/abc" and first[0]["verified"]
    assert [r for r in got if r["page_id"] == 2] and not [r for r in got if r["page_id"] > 2]
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000001F40000012C") + b"\0" * 20
    assert tuple(spark.createDataFrame([(png,)], "c binary").select(parse.image_info(F.col("c")).alias("i")).first()["i"]) == ("png", 500, 300)


def test_sources(spark, tmp_path):
    path = str(tmp_path / "missing.json")
    assert tables.read_json(spark, path, "a int").count() == 0
    (tmp_path / "d.json").write_text('{"products": [{"id": "a"}, {"id": "b"}]}')
    from pyspark.sql import types as T

    got = tables.read_list(spark, str(tmp_path / "d.json"), "products", T.StructType([T.StructField("id", T.StringType())]))
    assert [(r["ord"], r["id"]) for r in got.orderBy("ord").collect()] == [(0, "a"), (1, "b")]
    rows = spark.createDataFrame([(1, "published"), (2, "review")], "id int, status string")
    assert tables.write_version(rows, str(tmp_path / "v"), 0) == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write_version(rows, str(tmp_path / "v"), 0)
    tables.write_split(rows, "status", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert tables.decode_payload(tables.encode_payload(rows), "id int, status string").count() == 2


def test_embedded_json():
    from harrow.functions.embedded import walk

    text = '{"@graph": [{"name": "A", "offers": {"endDate": "2026-01-01", "n": 1}}], "name": true, "url": ["x"], "deep": ' + '{"a":' * 40 + '{"name": "far"}' + "}" * 40 + "}"
    assert [(f["path"], f["value"]) for f in walk(text, {"name", "endDate", "url"})] == [("$.@graph[0].name", "A"), ("$.@graph[0].offers.endDate", "2026-01-01")]
    assert walk("{broken", {"name"}) == []


def test_embedded_fields_of_pages(spark):
    from harrow.functions.embedded import embedded_fields

    html = '<script type="application/ld+json">{"name": "イベント"}</script><script id="__NEXT_DATA__">{"p": {"url": "https://a.jp/"}}</script>'
    rows = spark.createDataFrame([(html,), (None,)], "html string").select(embedded_fields(F.col("html")).alias("f")).collect()
    assert [(x["name"], x["value"]) for x in rows[0]["f"]] == [("name", "イベント"), ("url", "https://a.jp/")] and rows[1]["f"] == []


def test_rankings(spark):
    from harrow.operators import rank

    rows = spark.createDataFrame([(1, 0, "aa"), (1, 1, "b the"), (1, 2, "ccc the"), (1, 3, "aa"), (2, 0, "z")], "g int, o int, v string")
    got = {r["g"]: (r["v"], r["alternatives"]) for r in rank.best_with_alternatives(rows, ["g"], "v", rank.pattern_score(F.col("v"), [("the", 10)]), "o", near=5).collect()}
    assert got == {1: ("ccc the", ["b the"]), 2: ("z", [])}
