"""Both gates, enrichment, application destinations, addresses, public tables and run outputs on small rows: nulls, empties, ties."""

import re
import unicodedata
from urllib.parse import quote

from pyspark.sql import functions as F

from harrow.functions import text as tx
from harrow.functions import urls
from harrow.operators import gate, health, match, merge, products
from harrow.sources import tables

CANDIDATE = "key long, sourceKind string, manualEntry boolean, noticeOnly boolean, officialAccount boolean, officialNotice boolean, shop string, product string, applyStartDate string, applyEndDate string, resultStartDate string, purchaseStartDate string, purchaseEndDate string, rawApplyText string, url string, sourceUrl string, purchasePolicy boolean, context string, confidence double"


def candidate(key, **given):
    plain = {"key": key, "sourceKind": "web", "shop": "s", "product": "p", "applyStartDate": "2026-01-01", "applyEndDate": "2026-01-05", "resultStartDate": "2026-01-08", "url": "https://a.example.jp/e", "sourceUrl": "https://b.example.jp/", "purchasePolicy": True, "context": "", "confidence": 0.5}
    return tuple((plain | given).get(c.split()[0]) for c in CANDIDATE.split(", "))


def test_both_gates(spark):
    rows = spark.createDataFrame([
        candidate(1), candidate(2, manualEntry=True, applyEndDate=None, url=None), candidate(3, manualEntry=True, url=None), candidate(4, sourceKind="x", url=""), candidate(5, sourceKind="aggregated"), candidate(6, sourceKind="aggregated"),
        candidate(7, applyStartDate="2026-02-01"), candidate(8, rawApplyText="締切 1/5(火)"), candidate(9, noticeOnly=True, officialAccount=True, sourceKind="x", url="https://x.com/a"), candidate(10, confidence=None, context="再販"),
    ], CANDIDATE)
    matches = spark.createDataFrame([(k, 100 + k, f"Name {k}", "2026-01-10") for k in (1, 3, 4, 5, 6, 7, 8, 9, 10)], "key long, catalog_id long, catalog_name string, release string")
    verified = spark.createDataFrame([(5, True), (6, False)], "key long, ok boolean")
    votes = spark.createDataFrame([(6, True, 0.95), (7, False, 0.99)], "key long, accepted boolean, confidence double")
    got = {r["key"]: r for r in gate.decide(rows, matches, verified, F.lit("2026-01-02").cast("timestamp"), [], votes).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "published", 2: "review", 3: "published", 4: "review", 5: "published", 6: "review", 7: "rejected", 8: "rejected", 9: "published", 10: "published"}
    assert got[2]["reasons"] == ["incomplete"] and got[6]["reasons"] == ["unverified"] and got[7]["reasons"] == ["order"] and got[8]["reasons"] == ["weekday"] and got[4]["reasons"] == ["no_host"]
    assert (got[1]["product"], got[1]["purchaseStartDate"], got[1]["confidence"]) == ("Name 1", "2026-01-10", 0.86) and got[10]["purchaseStartDate"] == "" and got[3]["confidence"] == 0.99
    assert got[6]["confidence"] == 0.95 and got[7]["confidence"] == 0.5 and got[9]["destinationVerified"] and not got[3]["directVerified"] and got[1]["directVerified"]


def test_enrichment_keeps_what_a_page_lacks(spark):
    items = spark.createDataFrame([(1, "https://forms.gle/Ab1?utm_source=x", "s", None, "北海道", None, "m"), (2, "https://forms.gle/none", "s", "p", "北海道", 0.2, "m"), (3, None, None, None, None, None, None)], "k int, url string, shop string, product string, area string, confidence double, memo string")
    read = spark.createDataFrame([("https://forms.gle/Ab1", 2, "late", "P", "東京都", 0.99, ""), ("https://forms.gle/Ab1/", 1, "", "P", "全国", 0.5, None), (None, 0, "z", "z", "z", 1.0, "z")], "url string, ord int, shop string, product string, area string, confidence double, memo string")
    got = {r["k"]: tuple(r)[2:] for r in merge.enrich_applications(items, read).collect()}
    assert got == {1: ("s", "P", "北海道", 0.9, "m", True), 2: ("s", "p", "北海道", 0.2, "m", False), 3: (None, None, None, None, None, False)}


def test_applications_of_other_shops_are_cleared(spark):
    fields = "k int, shop string, product string, url string, sourceUrl string, fallbackUrl string, instructions string, memo string, destinationType string, appId string, appName string, appUrl string, iosAppStoreUrl string, androidAppStoreUrl string, appOfficialUrl string"
    row = lambda k, **g: tuple(({"k": k} | g).get(c.split()[0]) for c in fields.split(", "))
    rows = spark.createDataFrame([
        row(1, shop="ふるいち青店", destinationType="app", appId="geo", appName="ゲオアプリ", fallbackUrl="https://geo-online.co.jp/x", url="https://a.jp/", instructions="ゲオアプリ内の抽選案内"), row(2, shop="よろず屋", appName="ゲオアプリ"),
        row(3, shop="ゲオ青店", memo="アプリ会員限定"), row(4, shop="ゲオルグ", memo="アプリ抽選"), row(5, shop="ふるいち", destinationType="app", url="https://liff.line.me/1"), row(6),
    ], fields)
    got = {r["k"]: (r["repaired"], r["destinationType"], r["appId"], r["appUrl"], r["fallbackUrl"] or "", r["instructions"] or "") for r in products.with_app_destination(rows).collect()}
    assert got == {
        1: (True, "direct", "", "", "https://a.jp/", ""), 2: (True, "direct", "", "", "", ""), 3: (False, "app", "geo", "", "https://apps.apple.com/jp/app/id590190880", ""), 4: (False, "app", "", "", "", ""),
        5: (False, "app", "furuichi", "https://liff.line.me/1", "https://www.furu1.net/point-card.html", ""), 6: (False, "direct", "", "", "", ""),
    }


def test_addresses_as_the_standard_writes_them(spark):
    cases = {
        "https://Example.org": "https://example.org/", " http://a.org:080/x/../y/./z/.. ": "http://a.org/y/", "https://a.org:443/%2e%2E/é?ü=ä'#ö`": "https://a.org/%C3%A9?%C3%BC=%C3%A4%27#%C3%B6%60", "HTTP:\\\\a.org\\b\tc": "http://a.org/bc",
        "https://bücher.例え.jp/": "https://xn--bcher-kva.xn--r8jz45g.jp/", "https://a.org/a b%20c?d e": "https://a.org/a%20b%20c?d%20e", "https://u:p@a.org:99999/": None, "https://a b.org/": None, "ftp://a.org/": None, "no": None, "": None, "https://a.org/?": "https://a.org/?", "https://u@A.org:8080/..": "https://u@a.org:8080/",
        "https://ＡＢＣ.org/😀": "https://abc.org/%F0%9F%98%80",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "u string, x string")
    assert {r["u"]: r["s"] for r in rows.select("u", urls.standard_url(F.col("u")).alias("s")).collect()} == {**cases, None: None}


def test_standard_urls_of_documents_equal_brute_force(spark, sf):
    from harrow.plans.gate_queries import standard_urls

    def brute(raw):
        host, a, b, c, q, f = re.fullmatch(r" HTTP://(.*)\.Example\.org:80/a/\./(.*)/%2E%2e/(.*)/(x) y\?q=(.*)'<#(.*)`\t", raw).groups()
        label = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", host).lower())
        name = label if label.isascii() else "xn--" + label.encode("punycode").decode()
        return f"http://{name}.example.org/a/{quote(b, safe='')}/x%20y?q={quote(q)}%27%3C#{quote(f)}%60"

    got = standard_urls(spark, sf).collect()
    assert len(got) > 100 and all(r["url"] == brute(r["raw"]) for r in got) and any("xn--" in r["url"] for r in got)
    assert all(r["canonical"] == r["url"].split("?")[0] for r in got)


def test_labels_that_all_begin_alike_meet_few_texts(spark):
    """Every label and text has the same first gram; the pairs that meet are those that are found."""
    names = [f"series pack number {i:04d} end" for i in range(400)]
    rows = spark.createDataFrame([(i, "the " + n) for i, n in enumerate(names)], "i int, t string")
    labels = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, label string")
    got = match.longest_label(rows, "t", labels).collect()
    assert all(r["id"] == r["i"] for r in got) and len(got) == 400
    pairs = match._held_pairs(rows.select("t"), "t", labels.select("label"), "label", 4)
    assert pairs.count() == 400


def test_generic_values_match_groups_only(spark):
    values = spark.createDataFrame([("pack", True), ("set", True), ("packnew", False), ("xx", True), (None, True), ("pack", False)], "v string, g boolean")
    labels = spark.createDataFrame([(1, 0, "packnew", False), (2, 0, "pack", True), (3, 0, "pack", True), (4, 0, "set", False), (5, 0, "xx", True)], "id long, ordinal int, key string, is_group boolean")
    got = {(r["name"], r["kind"]): r["id"] for r in match.best_match(values.select(F.col("v").alias("name"), F.col("g").alias("kind"), "v", "g"), "v", labels, row_cols=["name", "kind"], generic="g").collect()}
    assert got == {("pack", True): 2, ("pack", False): 2, ("packnew", False): 1}


def test_keys_of_nothing(spark):
    rows = spark.createDataFrame([(None,), ("",), ("「」 ・",), ("ＭＥＧＡ ボックス",)], "n string")
    got = [tuple(r) for r in rows.select(*[tx.key_of(F.col("n"), k).alias(k) for k in ("gate", "groups", "catalog", "identity", "destination")]).collect()]
    assert got[:3] == [("",) * 5] * 3 and got[3] == ("mega", "ボックス", "megaボックス", "megaボックス", "megaボックス")


def test_public_tables_and_runs(spark, tmp_path):
    feed = spark.createDataFrame([(1, "https://a.blocked.jp/", "s", "web", "published"), (2, None, "s", "x", None), (3, "https://b.jp/", "s", "x", "rejected")], "k int, url string, sourceUrl string, sourceKind string, status string")
    shown = tables.public_tables(feed, feed.select("k", "sourceUrl"), feed.select("k"), ["blocked.jp"])
    tables.write_public(shown, f"file://{tmp_path}/public")
    tables.write_public(shown, f"file://{tmp_path}/public")  # again, over the first
    back = spark.read.json(f"{tmp_path}/public/feed")
    assert {r["k"] for r in back.collect()} == {2, 3} and "sourceUrl" not in back.columns and "sourceKind" not in back.columns
    tables.write_run(feed, f"{tmp_path}/run", feed.select("k"))
    assert {(r["status"], r["k"]) for r in spark.read.parquet(f"{tmp_path}/run/records").collect()} == {("published", 1), ("review", 2), ("rejected", 3)}
    assert spark.read.json(f"{tmp_path}/run/quality").first().asDict() == {"candidates": 3, "published": 1, "review": 1, "rejected": 1}
    assert {r["sourceKind"]: r["candidates"] for r in spark.read.json(f"{tmp_path}/run/status").collect()} == {"web": 1, "x": 2} and spark.read.parquet(f"{tmp_path}/run/state").count() == 3


def test_report_of_all_sources(spark):
    results = spark.createDataFrame([("a", True, None, None, 2, 1), ("b|c", False, "warning", "x\ny", None, None)], "name string, ok boolean, severity string, error string, items int, pages int")
    told = health.health_report(results).first()
    assert (told["level"], told["exit_code"], told["checked"]) == ("warning", 0, 2) and "b\\|c | ⚠️" in told["table"] and [a["level"] for a in told["annotations"]] == ["warning"]
    search = spark.createDataFrame([("search_failed",)], "status string")
    assert health.health_report(results, search).first()["exit_code"] == 1 and health.health_report(results.where("false")).first()["level"] == "ok"
