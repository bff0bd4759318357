"""Versioned tables, state over streams, recorded responses, embedded data: writers at once, triggers, failures, bounds."""

import json
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harrow.functions.embedded import walk_pages
from harrow.sources.recorded import read_recorded
from harrow.sources.versions import Conflict, VersionedTable
from harrow.streaming.tracker import Retention, rocks_state, track

NOW = datetime(2026, 1, 1)


def rows(spark, *values):
    return spark.createDataFrame([(k, v, NOW + timedelta(days=d)) for k, v, d in values], "k string, v string, at timestamp")


def kept(table):
    return {r["k"]: r["v"] for r in table.read().collect()}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Six threads upsert a key each, all from the version that they find; each commit is one version."""
    root = f"file://{tmp_path}/t"
    VersionedTable(spark, root, "k", "at").upsert(rows(spark, ("first", "0", 0)))
    failed, start = [], threading.Barrier(6)

    def write(i):
        try:
            start.wait()
            VersionedTable(spark, root, "k", "at", tries=30).upsert(rows(spark, (f"w{i}", str(i), i)))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table = VersionedTable(spark, root, "k", "at")
    assert not failed and table.version() == 7 and kept(table) == {"first": "0", **{f"w{i}": str(i) for i in range(6)}}


def test_a_lost_race_is_tried_again_and_then_told(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    table, other = VersionedTable(spark, root, "k", "at", tries=2), VersionedTable(spark, root, "k", "at")
    table.upsert(rows(spark, ("a", "1", 0)))
    turns = []

    def slow(old, deleted):
        if len(turns) < 1:
            turns.append(1)
            other.upsert(rows(spark, ("b", "2", 0)))  # the other one commits first
        return old.unionByName(rows(spark, ("c", "3", 0))), deleted

    assert table.change(slow) == 3 and kept(table) == {"a": "1", "b": "2", "c": "3"}

    def always(old, deleted):
        other.upsert(rows(spark, ("d", "4", 0)))
        return old, deleted

    with pytest.raises(Conflict):
        table.change(always)
    assert not table._claim(1, "x" * 32)  # a version is claimed once


def test_tombstones_repair_and_old_versions(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k", "at", tombstones=2)
    assert table.version() == 0 and table.read() is None
    with pytest.raises(ValueError):
        table.delete(rows(spark, ("a", "", 0)), F.lit(NOW))
    table.upsert(rows(spark, ("a", "old", 0), ("a", None, 1), ("b", "1", 0), ("c", "1", 0), (None, "x", 0)))
    assert kept(table) == {"a": "old", "b": "1", "c": "1"}  # the newest row's nulls are filled
    for i, k in enumerate("bcz"):
        table.delete(rows(spark, (k, "", 0)), F.lit(NOW + timedelta(days=i)))
    assert kept(table) == {"a": "old"} and {r["k"] for r in table.deleted().collect()} == {"c", "z"}
    table.upsert(rows(spark, ("c", "back", 3)))
    assert {r["k"] for r in table.deleted().collect()} == {"z"}
    table.repair(lambda r: r.withColumn("v", F.upper("v")))
    assert kept(table) == {"a": "OLD", "c": "BACK"}
    first = table.version()
    table.forget(keep=1)
    assert kept(table) == {"a": "OLD", "c": "BACK"} and table.version() == first


def test_keys_that_come_back_cost_no_other_tombstone(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k", "at", tombstones=2)
    table.upsert(rows(spark, *[(k, "1", 0) for k in "abcde"]))
    table.delete(rows(spark, *[(k, "", 0) for k in "abcd"]), F.lit(NOW))
    table.upsert(rows(spark, ("a", "back", 1)))
    assert {r["k"] for r in table.deleted().collect()} == {"b", "c"}
    table.repair()
    assert {r["k"] for r in table.deleted().collect()} == {"b", "c"} and table._all_deleted(table.version()).count() == 2


def test_the_last_seen_stay_across_triggers(spark, tmp_path):
    """The state store gives candidates by name; who goes when there are too many is told by time."""
    hour = lambda n: NOW + timedelta(hours=n)
    files = [[("s", "z", hour(0), "f"), ("s", "a", hour(1), "f")], [("s", "m", hour(2), "f"), ("s", "a", hour(3), "f"), ("s", "z", hour(4), "f")]]
    schema = "source string, candidate string, at timestamp, fingerprint string"
    with rocks_state(spark):
        for part in files:
            spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            track(stream, Retention(5, 3, 2)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = [(r["candidate"], r["first_seen"]) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("at").collect()]
    assert got == [("z", True), ("a", True), ("m", True), ("a", False), ("z", True)]


def test_state_crosses_triggers_and_is_freed(spark, tmp_path):
    """Each file is a trigger; a source that no row comes for is freed by its timer, and known again as new."""
    day = lambda n, h=0: NOW + timedelta(days=n, hours=h)
    files = [
        [("s", None, day(0), "r1"), ("s", "c", day(0, 1), "f1"), ("t", "c", day(0), "f1")],
        [("s", None, day(1), "r2"), ("s", "c", day(1, 1), "f1"), ("s", "d", day(1, 2), "f1"), ("s", "e", day(1, 3), "f1")],
        [("s", "c", day(2), "f2"), ("s", "d", day(2, 1), "f9")],
        [("u", "c", day(20), "f1")],
        [("s", None, day(21), "r2"), ("s", "c", day(21, 1), "f2")],
    ]
    schema = "source string, candidate string, at timestamp, fingerprint string"
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with rocks_state(spark):
        running = track(stream, Retention(5, 3, 2)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        running.awaitTermination()
    assert len([p for p in running.recentProgress if p["numInputRows"]]) == 5
    got = [(r["source"], r["candidate"], r["first_seen"], r["changed"], r["n_candidates"]) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("at", "source", F.asc_nulls_first("candidate")).collect()]
    assert got == [
        ("s", None, True, False, 0), ("t", "c", True, False, 1), ("s", "c", True, False, 1), ("s", None, False, True, 1), ("s", "c", False, False, 1), ("s", "d", True, False, 2), ("s", "e", True, False, 2),
        ("s", "c", True, False, 2), ("s", "d", True, False, 2), ("u", "c", True, False, 1), ("s", None, True, False, 0), ("s", "c", True, False, 1),
    ]


def test_recorded_failures(spark, tmp_path):
    def save(batch, *answers):
        folder = tmp_path / f"batch={batch}"
        folder.mkdir()
        (folder / "a.json").write_text("\n".join(json.dumps(a) for a in answers))

    u = "https://a.example.org/"
    loop = [{"url": f"{u}l{i}", "status": 301, "location": f"/l{i + 1}"} for i in range(9)]
    save(0, {"url": u + "ok", "ord": 1, "status": 200, "type": "text/html", "body": "é", "next": "/ok2"}, {"url": u + "ok2", "status": 200, "type": "text/html", "body": "2", "next": "/ok"}, {**loop[0], "ord": 0}, *loop[1:])
    save(7, {"url": u + "away", "ord": 0, "status": 302, "location": "https://b.example.com/x"}, {"url": u + "odd", "ord": 1, "status": 302, "location": "ftp://a.example.org/x"}, {"url": "https://b.example.com/x", "status": 200, "type": "text/html", "body": "x" * 50}, {"url": u + "big", "ord": 2, "status": 200, "type": "text/html", "body": "x" * 51})
    (tmp_path / "_note").mkdir()
    got = sorted((r["batch"], r["ord"], r["page"], r["body"], r["failure"]) for r in read_recorded(spark, str(tmp_path), mostBytes="50", pages="3", hosts="example.com").collect())
    assert got == [
        (0, 0, 1, None, "too many redirects"), (0, 1, 1, "é", None), (0, 1, 2, "2", None), (0, 1, 3, "é", None), (7, 0, 1, "x" * 50, None), (7, 1, 1, None, "redirect to another site"), (7, 2, 1, None, "too large"),
    ]


def test_walk_is_bounded_in_depth_and_nodes(spark):
    page = lambda value: f"<script type='application/ld+json'>{value}</script>"
    deep = json.dumps({"a": {"b": {"c": 1}}, "s": "&amp;", "n": None})
    data = spark.createDataFrame([(1, page(deep)), (2, page("{no json")), (3, None), (4, page(json.dumps(list(range(9))))), (5, page(deep) + page('["x"]'))], "k int, html string")
    walked = lambda **b: sorted((r["k"], r["block"], r["path"], r["value"]) for r in walk_pages(data, ["k"], "html", **b).collect())
    whole = walked()
    assert [w for w in whole if w[0] == 1] == [(1, 0, "$.a.b.c", "1"), (1, 0, "$.n", None), (1, 0, "$.s", "&")] and len([w for w in whole if w[0] == 4]) == 9 and (5, 1, "$[0]", "x") in whole and not [w for w in whole if w[0] in (2, 3)]
    assert not [w for w in walked(depth=2) if w[2] == "$.a.b.c"] and len([w for w in walked(nodes=4) if w[0] == 4]) == 4
