"""Layouts, screens, scored sections, places and readings on small texts: nulls, empty ones, ties, and what queries don't reach."""

import pytest
from pyspark.sql import functions as F

from harrow.functions import dates
from harrow.functions import text as tx
from harrow.operators import catalog_pages, notices, places, rank, reader, screen_text, sections



def base():
    return F.lit("2026-01-10").cast("date")


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def column(spark, rows, expr):
    return [r["x"] for r in rows.select("i", expr.alias("x")).orderBy("i").collect()]


def test_glyphs_in_numbers(spark):
    rows = texts(spark, "2O26/O7/1l", "I0.|2", "Olive oil.", "a/b", None)
    assert column(spark, rows, tx.repaired_numbers(F.col("t"))) == ["2026/07/11", "10.12", "Olive oil.", "a/b", None]


def test_years_carry_over_half_a_year(spark):
    rows = texts(spark, "12月30日 1月4日", "2026年1月4日〜12月30日", "2月30日 3/1 25:00 4/1", "11/2(日) 10:30〜2026/2/1T09:05:00", "", None)
    plain = rows.withColumn("t", dates.date_text(F.col("t")))
    got = [[(d["date"], d["time"]) for d in r] for r in column(spark, plain, dates.carried_days(F.col("t"), base()))]
    assert got == [[("2025-12-30", ""), ("2026-01-04", "")], [("2026-01-04", ""), ("2025-12-30", "")], [("2026-04-01", "")], [("2025-11-02", "10:30"), ("2026-02-01", "09:05")], [], []]


def test_screen_days_turn_only_at_the_end_of_the_year(spark):
    rows = texts(spark, "11月3日 2月1日", "3月1日 2月1日", "13月1日 2月31日")
    got = [[d["date"] for d in r] for r in column(spark, rows, dates.screen_days(F.col("t"), F.lit(2025)))]
    assert got == [["2025-11-03", "2026-02-01"], ["2025-03-01", "2025-02-01"], ["2025-02-31"]]


def lines(rows):
    return rows.withColumn("t", dates.date_text(F.col("t"))).withColumn("l", sections.section_lines(F.col("t")))


def test_best_window_by_dates_then_heading_then_place(spark):
    queue = "先着販売受付\n受付期間：2026/1/1〜1/2\n"
    draw = "抽選受付\n受付期間：2026/2/1〜2/2\n"
    once = "応募締切 2026/3/1\n"
    rows = lines(texts(spark, queue + draw, draw + queue, once + "応募期間 2026/4/1〜4/2", "応募期間\n販売終了\n2026/4/1", "応募期間 2026/1/1〜1/2\nx\n応募期間 2026/5/1〜5/2", "なし", None))
    best = column(spark, rows, sections.labelled_section(F.col("l"), sections.APPLY)["text"])
    assert [b and b[:8] for b in best] == ["2026/2/1", "2026/2/1", "2026/4/1", None, "2026/1/1", None, None]


def test_windows_anywhere_and_keyed_days(spark):
    rows = lines(texts(spark, "ここで応募期間は2026/1/5〜1/7です", 'x {"entryStartAt": "2026-01-05T10:00:00", "deadlineAt":"1/9"}', "受付開始日：1月6日", None))
    assert column(spark, rows, sections.near_section(F.col("t"), sections.APPLY))[0].startswith("は2026/1/5")
    keyed = column(spark, rows, sections.keyed_day(F.col("t"), ("entryStartAt", "受付開始日"), base()))
    assert [k and (k["date"], k["time"]) for k in keyed] == [None, ("2026-01-05", "10:00"), ("2026-01-06", ""), None]


def test_page_range_needs_two_days_off_the_sale(spark):
    rows = lines(texts(spark, "応募 2026/1/1〜1/2\n開催日程\n2026/3/1〜3/4\n2/1〜2/1", "2026/1/1", ""))
    got = column(spark, rows, sections.page_range(F.col("l"), base()))
    assert [g and (g["start"], g["end"]) for g in got] == [("2026-03-01", "2026-03-04"), None, None]


def test_consensus_of_an_array(spark):
    rows = spark.createDataFrame([(0, [("A-b", 5.0, 0), ("ab", 9.0, 1), ("c", 30.0, 2), ("「c」", 30.0, 3), ("", 99.0, 4)]), (1, [])], "i int, c array<struct<name: string, score: double, i: int>>")
    got = column(spark, rows, rank.consensus(F.col("c"), near=21))
    assert (got[0]["name"], got[0]["score"], got[0]["names"], got[0]["contested"]) == ("c", 30.0, ["c", "ab"], True)
    assert (got[1]["name"], got[1]["names"], got[1]["contested"]) == ("", [], False)


def test_consensus_of_rows_has_no_group_without_keys(spark):
    rows = spark.createDataFrame([("a", "x", 3, 1), ("a", "X", 5, 2), ("a", "y", 1, 3), ("b", "", 9, 1), (None, "z", 1, 1)], "g string, v string, s int, o int")
    got = {r["g"]: (r["v"], r["score"], r["names"]) for r in rank.consensus_choice(rows, ["g"], "v", rank.consensus_key(F.col("v")), F.col("s"), "o").collect()}
    assert got == {"a": ("X", 5, ["X", "y"]), None: ("z", 1, ["z"])}


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_labels_by_automaton_and_by_grams(spark, most):
    labels = spark.createDataFrame([(3, "abcd"), (1, "abc"), (2, "xyz"), (7, "abc"), (9, "")], "id long, label string")
    got = places.best_label(texts(spark, "__abcde xyz", "zabc", "xy z", "", None), "t", labels, most_bytes=most)
    assert {r["i"]: (r["id"], r["label"]) for r in got.collect()} == {0: (3, "abcd"), 1: (1, "abc"), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_ranked_labels_need_the_automaton(spark):
    labels = spark.createDataFrame([(1, "abc", 1)], "id long, label string, rank long")
    with pytest.raises(ValueError):
        places.best_label(texts(spark, "abc"), "t", labels, most_bytes=0)
    empty = places.best_label(texts(spark, "abc"), "t", labels.where("false")).first()
    assert empty["id"] is None and empty["label"] is None


def test_stores_and_ways_to_get_goods(spark):
    stores = spark.createDataFrame([(1, "青空書店 海辺店", ["青空海辺"], "広島県"), (2, "緑堂", None, "nowhere"), (3, "森", ["森"], "東京都")], "store_id long, name string, aliases array<string>, prefecture string")
    rows = spark.createDataFrame([(0, "青空 海辺 抽選応募 店頭購入", "x"), (1, "オンラインショップ 全国発送", "青空海辺"), (2, "店頭受取 発送も可能", "札幌店"), (3, "応募", "森"), (4, None, None)], "i int, t string, s string")
    got = {r["i"]: (r["prefecture"], r["fulfilment"], r["area"]) for r in places.with_location(rows, "t", "s", F.lit("東京都"), F.lit(""), stores).collect()}
    assert got == {0: ("広島県", "店舗", "広島県"), 1: ("広島県", "通販", "全国"), 2: ("北海道", "通販", "北海道"), 3: ("", "通販", "全国"), 4: ("", "通販", "全国")}


def test_screens_without_anything(spark):
    got = screen_text.read_screens(texts(spark, "日程なし", "", None), "t", F.lit(2025)).collect()
    assert {(r["shop"], r["product"], r["area"], r["kind"], r["apply"]["end"], r["confidence"]) for r in got} == {("", "", "全国", "通販", "", 0.0)}


def test_layouts_that_lead_on_give_nothing(spark):
    html = "<p>ポケモンカード 抽選 拡張パック A</p><p>応募期間 7/1〜7/2</p>"
    pages = spark.createDataFrame([(i, "https://a.jp/x", html, p, k) for i, (p, k) in enumerate([("livepocket-search", ["抽選"]), ("generic", None), ("generic", []), ("generic", ["抽選"]), ("geo-news", ["抽選", "ない語"]), (None, ["抽選"])])], "page_id int, url string, html string, parser string, keywords array<string>")
    got = notices.read_notices(pages, base(), layouts=("generic", "geo-news", "livepocket-search")).collect()
    assert sorted(r["page_id"] for r in got) == [3, 5]


def test_repeated_pages_and_notices(spark):
    link = "<p>拡張パック A</p><p>青書店・ポケカ</p><p>1/20</p><p><a href='https://b.jp/1'>応募ページ</a></p>"
    pages = spark.createDataFrame([(1, "https://a.jp/x", link * 3, "listing-intelligence-v1"), (1, "https://a.jp/y", link, "listing-intelligence-v1"), (None, "https://a.jp/z", link, "listing-intelligence-v1")], "page_id int, url string, html string, parser string")
    got = notices.read_notices(pages, base(), layouts=("listing-intelligence-v1",)).collect()
    assert sorted((r["source_url"], r["product"], r["applyEndDate"]) for r in got) == [(f"https://a.jp/{x}", "拡張パック A", "2026-01-20") for x in "xyz"]


def test_product_names_and_their_limits(spark):
    rows = texts(spark, "拡張パック「アオゾラ」", "拡張パック", "拡張パック柄のデッキケース", "ハイクラスパック 拡張パック 二つ", "商品一覧 拡張パック A", "スターターセットex ミナト 2026年5月1日発売")
    assert column(spark, rows, catalog_pages.product_names(F.col("t"))) == [["拡張パック アオゾラ"], [], [], [], ["拡張パック A"], ["スターターセットex ミナト"]]
    assert column(spark, rows, catalog_pages.aliases(F.lit("拡張パック アオゾラ")))[0] == ["拡張パック アオゾラ", "アオゾラ"]


def test_readings_of_nothing(spark):
    rows = spark.createDataFrame([(0, None, None), (1, "", "ご案内"), (2, "このフォームは回答の受け付けを終了しました", "")], "k int, text string, title string")
    got = {r["k"]: (r["reading"]["shop"], r["reading"]["product"], r["reading"]["missing"], r["reading"]["review"], r["status"]) for r in reader.read_forms(rows, base=base()).collect()}
    assert got[0][:2] == ("", "") and got[0][2] == ["店舗名", "商品名", "応募締切", "結果発表"] and got[0][3] and got[2][4] == "closed" and got[1][4] == "open"


def test_names_that_end_in_numbers_meet_few_texts(spark):
    """Names that differ by a number at their end alone: pairs of digits, which many share, bring none together, and beginnings that are shared take no room twice."""
    from harrow.operators import match

    names = [(i, f"拡張パック ソラ{i * 7919 % 100000:05d}") for i in range(500)]
    labels = spark.createDataFrame(names, "id long, label string")
    rows = spark.createDataFrame([(i, f"抽選\n{n} 1BOX") for i, n in names], "k long, t string")
    assert match._met_pairs(rows.select("t"), "t", labels.select("label"), "label", 2).count() == 500
    size = places._automaton_bytes(labels)
    assert size < 500 * 14 * places._NODE / 2
    for most in (size, 0):
        got = places.best_label(rows, "t", labels, most_bytes=most).collect()
        assert len(got) == 500 and all(r["id"] == r["k"] and r["label"] == names[r["k"]][1] for r in got)
