"""Queries of versioned tables, of state over streams, of recorded responses and of embedded data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harrow.plans.notice_queries import _query
from harrow.scratch import Scratch
from harrow.session import table


@_query(
    """with a as (select o_orderkey as k, o_custkey as c, o_orderdate as stamp from orders where o_orderkey % 3 = 0), u as (select o_orderkey as k, -o_custkey as c, o_orderdate + interval 1 day as stamp from orders where o_orderkey % 6 = 0 or o_orderkey % 5 = 0)
    select k, c, stamp, 'row' as kind from (select * from u union all select * from a where k not in (select k from u)) where k % 7 <> 0 or k % 35 = 0
    union all select k, null, null, 'deleted' from (select o_orderkey as k from orders where o_orderkey % 7 = 0 and o_orderkey % 35 <> 0 order by o_orderkey limit 500)"""
)
def versioned_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Two upserts, a delete, and an upsert that brings some of the deleted back, each a version; then the repair."""
    from harrow.sources.versions import VersionedTable

    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("stamp"))
    kept = VersionedTable(spark, f"{Scratch(spark, 'versions').root}/orders", "k", "stamp", tombstones=500)
    kept.upsert(orders.where("k % 3 = 0"))
    later = orders.where("k % 6 = 0 or k % 5 = 0").select("k", (-F.col("c")).alias("c"), (F.col("stamp") + F.expr("interval 1 day")).alias("stamp"))
    kept.upsert(later.unionByName(orders.where("k % 6 = 0")))  # the older row of a key loses
    kept.delete(orders.where("k % 7 = 0").select("k"), F.lit("2026-01-01"))
    kept.upsert(later.where("k % 35 = 0"))
    kept.repair()
    gone = kept.deleted().select("k", F.lit(None).cast("long").alias("c"), F.lit(None).cast("timestamp").alias("stamp"), F.lit("deleted").alias("kind"))
    return kept.read().select("k", "c", "stamp", F.lit("row").alias("kind")).unionByName(gone)


def _by_quarters(spark: SparkSession, sf: str, scratch: Scratch, start: Callable[[DataFrame], StreamingQuery], parts: int = 4) -> None:
    """Runs a stream over the events, a quarter of the time to each trigger. A quarter is written when the one before has been read: the order of
    files that lie there together would hang on the times that their file system gives them."""
    events = table(spark, sf, "events")
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    parts = 1 if ends["a"] is None else parts
    for i in range(parts):
        cut = lambda j: ends["a"] + (ends["b"] - ends["a"]) * j / parts
        part = events if parts == 1 else events.where((F.col("ts") >= F.lit(cut(i))) & ((F.col("ts") < F.lit(cut(i + 1))) | F.lit(i == parts - 1)))
        part.write.mode("append").parquet(f"{scratch.root}/events")
        start(spark.readStream.schema(events.schema).parquet(f"{scratch.root}/events")).awaitTermination()


_TRACKED = """with e as (select event_id, user_id::varchar as source, case when event_id % 5 = 0 then null else event_type || (event_id % 3) end as candidate, ts as seen, sha256(props) as fingerprint, row_number() over (partition by user_id order by ts, case when event_id % 5 = 0 then null else event_type || (event_id % 3) end nulls first, sha256(props)) as i from events),
    l as (select *, sum(fresh) over (partition by source order by i) as life from (select *, case when lag(seen) over (partition by source order by i) >= seen - interval 2 day then 0 else 1 end as fresh from e)),
    p as (select *, lag(i) over w as last_i, lag(seen) over w as last_at, lag(fingerprint) over w as last_fp from l window w as (partition by source, life, candidate order by i)),
    between_them as (select p.source, p.i, count(distinct q.candidate) as others from p join l q on q.source = p.source and q.life = p.life and q.candidate is not null and q.i > p.last_i and q.i < p.i where p.candidate is not null group by all),
    judged as (select p.*, coalesce(others, 0) as others, candidate is not null and coalesce(last_at >= seen - interval 1 day, false) and coalesce(others, 0) < 4 as held, candidate is null and last_at is not null as rooted from p left join between_them b on b.source = p.source and b.i = p.i)"""


@_query(
    f"""{_TRACKED} select source, candidate, seen, fingerprint, not (held or rooted) as first_seen, (held or rooted) and last_fp <> fingerprint as changed, held or rooted as known from judged"""
)
def tracked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as what is found at sources, in four triggers: a source is forgotten after two days, a candidate after one or when four others were seen since."""
    from harrow.streaming.tracker import Retention, rocks_state, track

    scratch = Scratch(spark, "tracked")
    candidate = F.when(F.col("event_id") % 5 != 0, F.concat("event_type", (F.col("event_id") % 3).cast("string")))

    def start(rows: DataFrame) -> StreamingQuery:
        observed = rows.select(F.col("user_id").cast("string").alias("source"), candidate.alias("candidate"), F.col("ts").alias("at"), F.sha2("props", 256).alias("fingerprint"))
        return track(observed, Retention(2, 1, 4)).writeStream.format("parquet").option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).outputMode("append").start(f"{scratch.root}/out")

    with rocks_state(spark):
        _by_quarters(spark, sf, scratch, start)
    return spark.read.parquet(f"{scratch.root}/out").select("source", "candidate", F.col("at").alias("seen"), "fingerprint", "first_seen", "changed", "known")


@_query(
    """select user_id, event_type, seen from (select user_id, event_type, ts as seen, row_number() over (partition by user_id order by ts desc, event_type desc) as r from events where event_type <> 'error') where r = 1 and seen >= (select max(ts) from events where event_type <> 'error') - interval 1 day"""
)
def carried_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The feed that foreachBatch keeps over four triggers: each user's newest usable event, as long as it is a day old at most."""
    from harrow.sources.versions import VersionedTable
    from harrow.streaming.tracker import carry_forward

    scratch = Scratch(spark, "carried")
    feed = VersionedTable(spark, f"{scratch.root}/feed", "user_id", "seen")
    merge = carry_forward(feed, 1, "seen", lambda r: r.where("event_type <> 'error'"))

    def start(rows: DataFrame) -> StreamingQuery:
        seen = rows.select("user_id", "event_type", F.col("ts").alias("seen"))
        return seen.writeStream.foreachBatch(merge).option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).start()

    _by_quarters(spark, sf, scratch, start)
    kept = feed.read()
    return kept.select("user_id", "event_type", "seen") if kept is not None else table(spark, sf, "events").select("user_id", "event_type", F.col("ts").alias("seen")).where("false")


@_query(
    """with p as (select page_id as k, 'https://saved.example.org/p' || page_id as url, html from pages), r as (select *, k % 13 = 0 and exists (select 1 from p q where q.k = p.k + 4) as moved from p),
    one as (select r.k, r.url, case when r.moved then t.k else r.k end as t, case when r.moved then t.url else r.url end as final_url, r.moved, case when r.moved then t.html else r.html end as html, case when r.moved then coalesce(t.moved, false) else false end as moved_on from r left join r t on t.k = r.k + 4),
    judged as (select *, case when k % 19 = 0 then 'timed out' when moved and t % 19 = 0 then 'timed out' when not moved and k % 13 <> 0 and k % 11 = 0 then 'HTTP 404' when k % 13 = 0 and not moved then 'redirect to another site' when moved and t % 11 = 0 then 'HTTP 404' when t % 17 = 0 then 'type image/png' end as failure from one)
    select (k % 4)::int as batch, 1 as page, url, case when k % 19 = 0 then url when failure = 'redirect to another site' then 'https://other.example.net/' else final_url end as final_url, failure, case when failure is null then sha256(html) end as body_sha256 from judged
    union all select (k % 4)::int, 2, url, final_url || '?page=2', null, sha256('page 2 of ' || t) from judged where failure is null and t % 3 = 0"""
)
def recorded_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Pages saved as responses in four batches, with redirects, second pages and failures, read by the data source."""
    from harrow.sources.recorded import read_recorded

    k = F.col("page_id")
    pages = table(spark, sf, "pages")
    known = pages.select((k - 4).alias("page_id"), F.lit(True).alias("has_next"))
    address = lambda n: F.concat(F.lit("https://saved.example.org/p"), n.cast("string"))
    moved, other = (k % 13 == 0) & F.col("has_next").isNotNull(), (k % 13 == 0) & F.col("has_next").isNull()
    first = pages.join(known, "page_id", "left").select(
        (k % 4).alias("batch"), address(k).alias("url"), k.alias("ord"), F.when(k % 13 == 0, 302).when(k % 11 == 0, 404).otherwise(200).alias("status"), F.when(k % 17 == 0, "image/png").otherwise("text/html; charset=utf-8").alias("type"),
        F.when(moved, F.concat(F.lit("/p"), (k + 4).cast("string"))).when(other, "https://other.example.net/").alias("location"), F.when(k % 3 == 0, "?page=2").alias("next"), F.when(k % 19 == 0, "timed out").alias("error"), F.col("html").alias("body"),
    )
    second = pages.where(k % 3 == 0).select(
        (k % 4).alias("batch"), F.concat(address(k), F.lit("?page=2")).alias("url"), F.lit(None).cast("long").alias("ord"), F.lit(200).alias("status"), F.lit("text/html").alias("type"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("next"),
        F.lit(None).cast("string").alias("error"), F.concat(F.lit("page 2 of "), k.cast("string")).alias("body"),
    )
    root = f"{Scratch(spark, 'responses').root}/saved"
    first.unionByName(second).write.partitionBy("batch").json(root)
    read = read_recorded(spark, root, hosts="example.com")
    return read.select("batch", "page", "url", "final_url", "failure", F.when(F.col("failure").isNull(), F.sha2("body", 256)).alias("body_sha256"))


@_query(
    """with l as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag) - 1 as i, l_linenumber as n, l_returnflag as flag from lineitem), o as (select o_orderkey as k, o_orderstatus as status, o_custkey as c from orders)
    select k, '$.order' as path, 'order' as name, k::varchar as value from o union all select k, '$.status', 'status', status from o union all select k, '$.by.customer.id', 'id', c::varchar from o
    union all select k, '$.lines[' || i || '].n', 'n', n::varchar from l join o using (k) union all select k, '$.lines[' || i || '].flag', 'flag', flag from l join o using (k)"""
)
def embedded_values(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as pages with their lines in JSON-LD, walked level by level."""
    from harrow.functions.embedded import walk_pages

    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_custkey").join(lines, "k", "left")
    data = F.to_json(F.struct(F.col("k").alias("order"), F.col("o_orderstatus").alias("status"), F.struct(F.struct(F.col("o_custkey").alias("id")).alias("customer")).alias("by"), "lines"))
    html = F.concat(F.lit("<html><script type='application/ld+json'>"), data, F.lit("</script><p>x</p></html>"))
    return walk_pages(orders.select("k", html.alias("html")), ["k"], "html").select("k", "path", "name", "value")
