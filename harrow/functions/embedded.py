"""JSON embedded in pages: JSON-LD blocks and application state, walked to named fields."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.text import decode_entities
from harrow.scratch import Scratch
from harrow.session import spread

#: A walk goes so deep and over so many nodes; what lies beyond isn't read.
DEPTH, NODES = 20, 30_000
FIELDS = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))

_LD = r'(?is)<script\b[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'
_STATE = r'(?is)<script\b[^>]*id=["\']__NEXT_DATA__["\'][^>]*>(.*?)</script>'


def json_blocks(html: Column) -> Column:
    """Texts of the JSON-LD blocks and the application state of a page."""
    html = F.coalesce(html, F.lit(""))
    return F.concat(F.regexp_extract_all(html, F.lit(_LD), 1), F.regexp_extract_all(html, F.lit(_STATE), 1))


def walk(text: str, names: set[str]) -> list[dict]:
    """Scalar fields of the given names, breadth first; text that is no JSON has none."""
    import json
    from collections import deque

    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return []
    out, todo, seen = [], deque([("$", root, 0)]), 0
    while todo and seen < NODES:
        path, node, depth = todo.popleft()
        seen += 1
        if depth > DEPTH:
            continue
        if isinstance(node, dict):
            for k, v in node.items():
                if k in names and isinstance(v, (str, int, float)) and not isinstance(v, bool):
                    out.append({"path": f"{path}.{k}", "name": k, "value": str(v)})
                elif isinstance(v, (dict, list)):
                    todo.append((f"{path}.{k}", v, depth + 1))
        elif isinstance(node, list):
            todo.extend((f"{path}[{i}]", v, depth + 1) for i, v in enumerate(node) if isinstance(v, (dict, list)))
    return out


def embedded_fields(html: Column, names: tuple[str, ...] = ("name", "startDate", "endDate", "url", "description")) -> Column:
    """array<struct<path, name, value>> of the named scalar fields in a page's embedded JSON, block after block."""
    wanted = set(names)

    @F.pandas_udf(FIELDS)
    def fields(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: [f for text in (b if b is not None else []) for f in walk(text, wanted)])

    return fields(json_blocks(html))


def walk_pages(pages: DataFrame, keys: list[str], html: str, depth: int = DEPTH, nodes: int = NODES) -> DataFrame:
    """The scalar values in pages' embedded JSON, level by level over VARIANT: keys, block, path, name (the last field's), value (text), level.

    Each level is one explode of the objects and lists of the level before it, written before the next one, so no level is worked out
    twice and no Python sees a value. A page's walk ends at `depth` levels or `nodes` nodes, whichever is first; nodes of a level count in the order of their
    places. Blocks that are no JSON, pages without any and null pages have no rows; null values have a null text. A value takes a character at least, so
    only the nodes of pages with more characters than `nodes` are counted, as one window's group, bounded by the page; all others move through no shuffle.
    """
    scratch = Scratch(pages.sparkSession, "walk")
    blocks = scratch.keep(spread(pages.select(*keys, F.posexplode(json_blocks(F.col(html))).alias("block", "text")), *keys), "blocks")
    sizes = blocks.groupBy(*keys).agg(F.sum(F.length("text")).alias("size"))
    large = scratch.keep(sizes.where(F.col("size") > nodes).select(*[F.col(k).alias(f"_{k}") for k in keys]), "large", free=True)
    if large.isEmpty():
        return _walk(scratch, blocks, keys, depth)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return _walk(scratch, blocks.join(large, same, "left_anti"), keys, depth).unionByName(_walk(scratch, blocks.join(large, same, "left_semi"), keys, depth, nodes))


def _walk(scratch: Scratch, blocks: DataFrame, keys: list[str], depth: int, nodes: int | None = None) -> DataFrame:
    """See walk_pages; without `nodes` none are counted."""
    spark = blocks.sparkSession
    level = blocks.select(
        *keys, "block", F.lit("$").alias("path"), F.array().cast("array<int>").alias("place"), F.lit(0).cast("long").alias("used"), F.try_parse_json(decode_entities(F.col("text"))).alias("v")
    ).where("v is not null")
    page = Window.partitionBy(*keys)
    out = None
    for k in range(1, depth + 1):
        inside = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        found = inside.select(*keys, "block", F.concat("path", step).alias("path"), F.concat("place", F.array("pos")).alias("place"), "used", F.col("key").alias("name"), F.col("value").alias("v"))
        if nodes is not None:
            counted = found.withColumns({"n": F.row_number().over(page.orderBy("block", "place")), "of": F.count("*").over(page)})
            found = counted.where(F.col("used") + F.col("n") <= nodes).withColumn("used", F.col("used") + F.col("of"))
        within = found.withColumn("kind", F.schema_of_variant("v"))
        holds = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        kept = scratch.keep(
            within.select(*keys, "block", "path", "place", "used", "name", F.when(holds, F.to_json("v")).alias("inner"), F.when(~holds, F.col("v").cast("string")).alias("value"), holds.alias("holds")),
            f"level-{k}" if nodes is None else f"counted-{k}",
        )
        leaves = kept.where(~F.col("holds")).select(*keys, "block", "path", "name", "value", F.lit(k).alias("level"))
        out = leaves if out is None else out.unionByName(leaves)
        level = kept.where("holds").select(*keys, "block", "path", "place", "used", F.parse_json("inner").alias("v"))
        if level.isEmpty():
            break
    return out
