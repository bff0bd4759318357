"""Parts of readings that layouts share: product lists, posts, two readings as one, recognised text, forms' states, image headers. Layouts are in notices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import dates
from harrow.functions import text as tx

#: How a page that speaks of cards is told.
CARD = "ポケモンカード|ポケカ|拡張パック|スターター|デッキ"


def explode_products(rows: DataFrame, products: str, most: int) -> DataFrame:
    """One row per distinct product, at most `most`, numbered from 1 in order."""
    rest = [c for c in rows.columns if c != products]
    return rows.select(*rest, F.posexplode(F.slice(F.array_distinct(products), 1, most)).alias("_n", "product")).select(*rest, (F.col("_n") + 1).alias("n"), "product")


def post_confidence(*signals: tuple[Column, float], start: float = 0.45) -> Column:
    """Base plus the weight of every signal that is there, at most 0.99."""
    total = F.lit(start)
    for cond, weight in signals:
        total = total + F.when(F.coalesce(cond, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(0.99), total), 2)


def clean_post(text: Column) -> Column:
    """Post text without addresses, mentions and tags."""
    return tx.js_trim(F.regexp_replace(F.regexp_replace(text, r"https?://\S+|[@＠#＃]\S+", " "), r"(?U)\s+", " "))


def merge_readings(primary: DataFrame, fallback: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Two readings of a page by key: the primary's filled fields, else the fallback's; `filled` counts the fields of the result."""
    a = primary.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = fallback.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields])
    both = a.join(b, key, "full_outer").select(key, *[tx.non_empty(F.col(f"_a_{f}"), F.col(f"_b_{f}")).alias(f) for f in fields])
    filled = F.lit(0)
    for f in fields:
        filled = filled + F.when(F.col(f) != "", 1).otherwise(0)
    return both.withColumn("filled", filled)


def add_ocr_text(pages: DataFrame, ocr: DataFrame, key: str) -> DataFrame:
    """Recognised text of a page's images as a block at the end of its HTML; recognition itself happens outside."""
    texts = ocr.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ocr_text"))), lambda t: t["ocr_text"]), "\n").alias("_t"))
    return pages.join(texts, key, "left").withColumn("html", F.when(F.col("_t").isNotNull(), F.concat("html", F.lit("\n<pre data-ocr>"), "_t", F.lit("</pre>"))).otherwise(F.col("html"))).drop("_t")


def needs_ocr(html: Column, least_products: int = 2) -> Column:
    """Whether a page's text has too few products or no deadline."""
    text = tx.html_to_text(html)
    return (F.regexp_count(text, F.lit(CARD)) < least_products) | ~text.rlike(dates.DEADLINE)


def form_access(text: Column) -> Column:
    """State of a form page: closed, restricted or open."""
    closed = "(?i)回答の受け付けを終了|回答の受け付けは終了|回答を受け付けていません|受付を終了|no longer accepting|not accepting responses"
    restricted = "(?i)権限が必要|ログインが必要|アクセス権が必要|組織内のユーザーのみ|need permission|permission|only be viewed by users in"
    return F.when(text.rlike(closed), "closed").when(text.rlike(restricted), "restricted").otherwise("open")


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def _jpeg_size(contents: pd.Series) -> pd.DataFrame:
    """Size in the first frame header of a JPEG, found from segment to segment."""

    def size(raw: bytes | None) -> tuple[int | None, int | None]:
        at = 2
        while raw is not None and at + 9 < len(raw):
            if raw[at] != 0xFF:
                at += 1
                continue
            if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
            length = int.from_bytes(raw[at + 2 : at + 4], "big")
            if length < 2:
                break
            at += 2 + length
        return None, None

    return pd.DataFrame([size(c) for c in contents], columns=["width", "height"]).astype("Int32")


def image_info(content: Column) -> Column:
    """struct(kind, width, height) of an image, from its bytes: PNG, GIF, WebP, SVG by their headers, JPEG by its segments (the only kind that Python sees)."""
    hexed = F.hex(F.substring(content, 1, 32))
    at = lambda start, n: F.conv(F.substring(hexed, 2 * start + 1, 2 * n), 16, 10).cast("long")
    little = lambda start, n=2: sum((at(start + i, 1) * (256**i) for i in range(1, n)), at(start, 1))
    head = F.decode(F.substring(content, 1, 2000), "ISO-8859-1")
    chunk = F.substring(hexed, 25, 8)
    jpeg = hexed.startswith("FFD8")
    kind = (
        F.when(hexed.startswith("89504E470D0A1A0A"), "png").when(hexed.startswith("474946"), "gif").when(jpeg, "jpeg").when(hexed.startswith("52494646") & (F.substring(hexed, 17, 8) == "57454250"), "webp")
        .when(F.left(head, F.lit(300)).contains("<svg"), "svg")
    )
    of_jpeg = _jpeg_size(F.when(jpeg, content))
    attribute = lambda n: F.regexp_extract(head, rf"""(?i)\b{n}=["'](\d+)""", 1).try_cast("long")
    box = lambda g: F.floor(F.regexp_extract(head, r"""(?i)viewBox=["'][^"']*\s(\d+(?:\.\d+)?)\s(\d+(?:\.\d+)?)""", g).try_cast("double"))
    sized = (F.coalesce(attribute("width"), F.lit(0)) > 0) & (F.coalesce(attribute("height"), F.lit(0)) > 0)
    bits = little(21, 4)
    webp = lambda x, v, l: F.when(chunk == "56503858", x).when(chunk == "56503820", v).when(chunk == "5650384C", l)  # noqa: E731, E741
    mask = F.lit(0x3FFF)
    width = (
        F.when(kind == "png", at(16, 4)).when(kind == "gif", little(6)).when(kind == "jpeg", of_jpeg["width"]).when(kind == "svg", F.when(sized, attribute("width")).otherwise(box(1)))
        .when(kind == "webp", webp(little(24, 3) + 1, little(26).bitwiseAND(mask), bits.bitwiseAND(mask) + 1))
    )
    height = (
        F.when(kind == "png", at(20, 4)).when(kind == "gif", little(8)).when(kind == "jpeg", of_jpeg["height"]).when(kind == "svg", F.when(sized, attribute("height")).otherwise(box(2)))
        .when(kind == "webp", webp(little(27, 3) + 1, little(28).bitwiseAND(mask), F.shiftright(bits, 14).bitwiseAND(mask) + 1))
    )
    return F.struct(kind.alias("kind"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def image_valid(content: Column, info: Column, least_bytes: int = 4000, least_side: int = 120) -> Column:
    """Whether an image is large enough to show: of a known kind, so many bytes, and so many pixels either way."""
    return F.coalesce(info["kind"].isNotNull() & (F.length(content) >= least_bytes) & (info["width"] >= least_side) & (info["height"] >= least_side), F.lit(False))
