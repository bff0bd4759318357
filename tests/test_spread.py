"""Work for each row is spread over the cores, and dates are told without a failing cast or a parse for each."""

import datetime

from pyspark.sql import functions as F

from harrow.functions import dates
from harrow.operators import notices
from harrow.plans.notice_queries import sales


def test_a_small_file_is_more_than_one_task(spark, sf):
    assert sales(spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_days_that_exist_by_the_calendar(spark):
    base = datetime.date(2026, 11, 20)
    days = [(y, m, d) for y in (2000, 2024, 2026, 2028, 2099) for m in range(0, 15) for d in range(0, 34)]
    data = spark.createDataFrame([(y, m, d, f"x {y}年{m}月{d}日 9:05", f"{m}/{d}") for y, m, d in days], "y int, m int, d int, whole string, short string")
    got = data.select("y", "m", "d", dates.carried_days(F.col("whole"), F.lit(base)).alias("w"), dates.carried_days(F.col("short"), F.lit(base)).alias("s"), dates.date_range(F.col("whole"), F.lit(base)).alias("r")).collect()

    def day(y, m, d):
        try:
            return datetime.date(y, m, d)
        except ValueError:
            return None

    for r in got:
        on = day(r["y"], r["m"], r["d"])
        assert [tuple(t) for t in r["w"]] == ([(on.isoformat(), "09:05")] if on else []), r
        near = [x for x in (day(y, r["m"], r["d"]) for y in (2026, 2025, 2027)) if x]
        assert [t["date"] for t in r["s"]] == ([min(near, key=lambda x: (abs((x - base).days), x.year)).isoformat()] if near else []), r
        assert (r["r"]["start"] and r["r"]["start"]["date"]) == (on.isoformat() if on else None), r


def test_a_name_is_looked_for_in_a_text_made_once(spark):
    data = spark.createDataFrame([("in 大阪府", "x"), ("", "宮城県 大阪府"), ("", "")], "a string, b string")
    told = data.select(notices.first_of(("宮城県", "大阪府"), F.concat_ws("~", "a", "b")).alias("p"))
    assert [r["p"] for r in told.collect()] == ["大阪府", "宮城県", None]
    assert "contains(concat_ws" not in told._jdf.queryExecution().optimizedPlan().toString().lower()
