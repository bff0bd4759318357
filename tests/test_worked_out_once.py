"""Steps that a plan holds once, however often their results are used: what Spark would otherwise work out again for each use."""

from harrow.functions import embedded
from harrow.plans.more import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_deadlines_of_listed_notices_are_read_once(spark):
    assert plan(spark, "notice_listing").count("23:59") == 1  # the time of a relative one


def test_news_without_images_send_nothing_to_python_for_them(spark):
    assert "_nfkc(null)" not in plan(spark, "notice_pairs")


def test_product_pages_are_read_in_one_row(spark):
    text = plan(spark, "product_pages")
    assert "Join" not in text
    assert text.count("data-original") == 1


def test_only_large_pages_have_their_nodes_counted(spark, monkeypatch):
    kept = []
    keep = embedded.Scratch.keep
    monkeypatch.setattr(embedded.Scratch, "keep", lambda self, df, name, *a, **k: kept.append(name) or keep(self, df, name, *a, **k))
    block = lambda data: f"<script type='application/ld+json'>{data}</script>"
    pages = [(1, block('{"a":[1,2]}')), (2, block(str(list(range(50)))) + block("[7]")), (None, block(str(list(range(40))))), (3, None)]
    walked = embedded.walk_pages(spark.createDataFrame(pages, "k long, html string"), ["k"], "html", nodes=20)
    got = sorted((r["k"] or 0, r["path"], r["value"]) for r in walked.collect())
    assert got == sorted([(1, "$.a[0]", "1"), (1, "$.a[1]", "2"), *[(k, f"$[{i}]", str(i)) for k in (0, 2) for i in range(20)]])
    assert {"level-1", "level-2", "counted-1"} <= set(kept)


def test_steps_of_lines_and_names_are_written_once(spark):
    """A label is looked for once in a period's lines, a name weighed once, a value tried once."""
    from pyspark.sql import functions as F

    from harrow.functions import text as tx
    from harrow.operators import notices

    rows = spark.createDataFrame([(["a", "label x", "b", "stop"], "t")], "lines array<string>, title string")
    told = rows.select(
        notices.labelled_lines(F.col("lines"), "^label", "^stop", 5).alias("l"), notices.labelled_lines(F.col("lines"), "^none", "^stop", 5).alias("m"),
        tx.non_empty(F.lit(None).cast("string"), F.regexp_extract("title", "(z)", 1), F.regexp_extract("title", "(t)", 1)).alias("n"),
    )
    assert tuple(told.first()) == (["label x", "b"], [], "t")
    text = told._jdf.queryExecution().optimizedPlan().toString()
    assert [text.count(p) for p in ("^label", "(z)", "(t)")] == [1, 1, 1]
