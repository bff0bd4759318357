"""Labels in texts, all at once, and what follows for shops: prefecture, pick-up or delivery, area.

A label table is looked up in texts by an Aho-Corasick automaton: one pass over each text finds every
label in it, whatever their number. The table is measured first; if its automaton takes up to
`most_bytes` it goes out to the tasks, where each Python worker builds it once. A larger table is
looked up by the gram join of `match`, whose rows are those grams of the texts that a label has.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import text as tx
from harrow.operators import match
from harrow.operators import vocabulary as words

#: Automata of this Python worker, by the names of their tables; as many as one plan is likely to use.
_BUILT: dict[str, object] = {}
_KEPT = 4
#: Bytes that a node of an automaton and a label beside its characters take in a worker, and labels so short that their shared beginnings are counted.
_NODE, _LABEL, _SHORT = 80, 32, 256


def _automaton(name: str, labels):
    """The automaton of a broadcast table of (label, id), best first, with its columns; built once in a worker, the oldest table's goes.
    It holds numbers of rows, so a label costs its nodes and no objects."""
    import ahocorasick
    import pyarrow as pa

    if name not in _BUILT:
        rows = pa.ipc.open_stream(labels.value).read_all()
        made, at = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
        for batch in rows.to_batches(max_chunksize=10_000):
            for label in batch.column("label").to_pylist():
                made.add_word(label, at)
                at += 1
        made.make_automaton()
        while len(_BUILT) >= _KEPT:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[name] = made, rows["label"].combine_chunks(), rows["id"].combine_chunks()
    return _BUILT[name]


def _finder(labels):
    """A pandas UDF: the first of the table's labels that each text holds, or nulls."""
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType())])
    name = uuid.uuid4().hex

    @F.pandas_udf(kind)
    def find(texts: pd.Series) -> pd.DataFrame:
        made, names, ids = _automaton(name, labels)
        found = []
        for text in texts:
            best = min((row for _, row in made.iter(text)), default=None) if text else None
            found.append((None, None) if best is None else (ids[best].as_py(), names[best].as_py()))
        return pd.DataFrame(found, columns=["id", "label"]).astype({"id": "Int64"})

    return find


def _automaton_bytes(labels: DataFrame) -> int:
    """What an automaton of distinct labels takes in a worker. It has a node for each distinct beginning of a label; those of long labels count as if none were shared."""
    told = labels.agg(F.count("*").alias("n"), F.sum(F.octet_length("label")).alias("octets"), F.sum(F.length("label")).alias("nodes"), F.max(F.length("label")).alias("longest")).first()
    nodes = told["nodes"] or 0
    if nodes and told["longest"] <= _SHORT:
        begins = labels.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("label")), lambda i: F.xxhash64(F.left("label", i)))).alias("b"))
        nodes = min(nodes, begins.agg(F.approx_count_distinct("b", 0.02).alias("b")).first()["b"])
    return nodes * _NODE + (told["octets"] or 0) + told["n"] * _LABEL


def best_label(texts: DataFrame, text_col: str, labels: DataFrame, most_bytes: int = 160 << 20) -> DataFrame:
    """texts with `id` and `label` of the best label that their text holds, null without one.

    labels: id (long), label, and optionally rank (smaller is better); without ranks the longest label is the best. Ties fall to
    the smaller id. Empty labels match nothing; of equal labels the best rank counts, then the smallest id. Tables whose automaton
    takes over `most_bytes` of a worker are joined on grams, the longest label being the best: ranks need the automaton.
    """
    import pyarrow as pa

    spark = texts.sparkSession
    ranked = labels.select(F.col("id").cast("long").alias("id"), "label", F.col("rank").cast("long") if "rank" in labels.columns else (-F.length("label")).cast("long").alias("rank"))
    once = ranked.where("label != ''").groupBy("label").agg(F.min(F.struct("rank", "id")).alias("best")).select("label", "best.rank", "best.id")
    size = _automaton_bytes(once)
    if size > most_bytes:
        if "rank" in labels.columns:
            raise ValueError(f"ranked labels of {size} bytes are beyond {most_bytes}")
        return match.longest_label(texts, text_col, once.select("id", "label"))
    if not size:
        return texts.withColumns({"id": F.lit(None).cast("long"), "label": F.lit(None).cast("string")})
    rows = once.orderBy("rank", "id", "label").select("label", "id").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    known = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    return texts.withColumn("_found", _finder(known)(F.col(text_col))).select(*texts.columns, F.col("_found.id").alias("id"), F.col("_found.label").alias("label"))


def store_key(text: Column) -> Column:
    """A shop's name as it is looked up: NFKC, without white space, lower case. `text` should be a plain column."""
    return F.lower(F.regexp_replace(tx.nfkc(F.coalesce(text, F.lit(""))), tx.WIDE_SPACE, ""))


def store_labels(stores: DataFrame, shortest: int = 3, prefectures: tuple[str, ...] = words.PREFECTURES) -> DataFrame:
    """stores (store_id, name, aliases, prefecture) -> id, label, prefecture: names and aliases as looked up, of `shortest` characters or more, of stores in a known prefecture."""
    known = stores.where(F.col("prefecture").isin(*prefectures))
    each = known.select(F.col("store_id").alias("id"), "prefecture", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    keyed = each.select("id", "prefecture", store_key(F.col("name")).alias("label")).where(F.length("label") >= shortest)
    return keyed.dropDuplicates(["id", "label"])


def place_labels(spark, prefectures: tuple[str, ...] = words.PREFECTURES, places: tuple[tuple[str, str], ...] = words.PLACES) -> DataFrame:
    """Prefectures, then towns, ranked in their given order: id (the prefecture's place in its list), label, rank."""
    rows = [(i, p, i) for i, p in enumerate(prefectures)] + [(prefectures.index(p), town, len(prefectures) + i) for i, (town, p) in enumerate(places)]
    return spark.createDataFrame(rows, "id long, label string, rank long")


def _prefectures(rows: DataFrame, text_col: str, stores: DataFrame | None, prefectures: tuple[str, ...]) -> DataFrame:
    """rows with `prefecture`, and `_plain`: what the text says without the stores."""
    found = best_label(rows, text_col, place_labels(rows.sparkSession, prefectures)).withColumnsRenamed({"id": "_place", "label": "_name"})
    of_place = F.when(F.col("_name").isNotNull(), F.get(F.split(F.lit("\n".join(prefectures)), "\n"), F.col("_place").cast("int")))
    found = found.withColumn("_plain", F.coalesce(of_place, F.lit("")))
    if stores is None:
        return found.withColumn("prefecture", F.col("_plain")).select(*rows.columns, "_plain", "prefecture")
    labels = store_labels(stores, prefectures=prefectures)
    keyed = best_label(found.withColumn("_key", store_key(F.col(text_col))), "_key", labels.select("id", "label")).withColumnsRenamed({"id": "_store", "label": "_label"})
    homes = labels.groupBy(F.col("id").alias("_store")).agg(F.min("prefecture").alias("_home"))
    named = F.when(F.col("_name").isin(*prefectures), F.col("_plain"))
    return keyed.join(homes, "_store", "left").withColumn("prefecture", F.coalesce(named, F.col("_home"), F.col("_plain"))).select(*rows.columns, "_plain", "prefecture")


def with_prefecture(rows: DataFrame, text_col: str, stores: DataFrame | None = None, prefectures: tuple[str, ...] = words.PREFECTURES) -> DataFrame:
    """rows with `prefecture`: one that the text names, else the one of the store whose name or alias it holds (the longest, then the
    smallest id), else that of the first town of the list; "" without any."""
    return _prefectures(rows, text_col, stores, prefectures).drop("_plain")


def fulfilment(text: Column, shop: Column, prefecture: Column, fallback: Column) -> Column:
    """店舗 (pick-up) or 通販 (delivery): by the words of either; where both occur, delivery if it is offered as well; else by a branch's name in a known prefecture, the fallback, the prefecture."""
    whole = F.concat_ws("\n", F.coalesce(shop, F.lit("")), F.coalesce(text, F.lit("")))
    picked, sent = whole.rlike(words.PICKUP), whole.rlike(words.SHIPPING)
    store, mail, known = F.lit("店舗"), F.lit("通販"), prefecture != ""
    branch = known & F.concat(F.coalesce(shop, F.lit("")), F.lit(" ")).rlike(words.BRANCH)
    return (
        F.when(picked & sent, F.when(whole.rlike(words.SHIPPING_TOO), mail).otherwise(store))
        .when(picked | branch & ~sent, store).when(sent, mail).when(fallback.isin("店舗", "通販"), fallback).when(known, store).otherwise(mail)
    )


def with_location(rows: DataFrame, text_col: str, shop_col: str, fallback_area: Column, fallback_type: Column, stores: DataFrame | None = None) -> DataFrame:
    """rows with `prefecture`, `fulfilment` and `area`: the whole country for what is only sent, else the prefecture, else a fallback that is one, else 未判定 (unknown)."""
    both = rows.withColumn("_whole", F.concat_ws("\n", F.coalesce(F.col(shop_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))
    placed = _prefectures(both, "_whole", stores, words.PREFECTURES)
    typed = placed.withColumn("fulfilment", fulfilment(F.col(text_col), F.col(shop_col), F.col("_plain"), F.coalesce(fallback_type, F.lit(""))))
    sent_only = F.col("_whole").rlike(words.SHIPPING) & ~F.col("_whole").rlike(words.PICKUP)
    everywhere = (F.col("fulfilment") == "通販") & (sent_only | (F.col("prefecture") == ""))
    area = F.when(everywhere, "全国").when(F.col("prefecture") != "", F.col("prefecture")).when(fallback_area.isin(*words.PREFECTURES), fallback_area).otherwise("未判定")
    return typed.withColumn("area", area).drop("_whole", "_plain")
