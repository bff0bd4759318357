"""Scans and sinks: JSON documents with a fallback, catalogs, manual records, images, versioned JSON, split outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import urls


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """JSON by a fixed schema; bad records are null rows, a missing path is an empty table."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fixture pages, one file each: url (the path), html."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def read_list(spark: SparkSession, path: str, name: str, item: T.StructType) -> DataFrame:
    """Rows of an array field of a JSON document, with their order as ord."""
    whole = read_json(spark, path, T.StructType([T.StructField(name, T.ArrayType(item))]))
    return whole.select(F.posexplode(name).alias("ord", "_r")).select("ord", "_r.*")


def manual_records(rows: DataFrame) -> DataFrame:
    """Manual records: constant marks, confidence at least 0.99."""
    return rows.withColumns({"sourceKind": F.lit("manual"), "verified": F.lit(True), "manualEntry": F.lit(True), "confidence": F.greatest(F.lit(0.99), F.coalesce(F.col("confidence"), F.lit(0.0)))})


def trusted(rows: DataFrame, version: int = 2) -> DataFrame:
    """Rows of an earlier run that may be carried on; the filter reaches the Parquet scan."""
    return rows.where((F.col("qualityVersion") >= version) & (F.col("verified") == F.lit(True)))


def read_images(spark: SparkSession, path: str, least: int = 8 * 1024, most: int = 5 * 1024 * 1024) -> DataFrame:
    """Image files of a usable size: path, length, content."""
    return spark.read.format("binaryFile").load(path).where(F.col("length").between(least, most)).select("path", "length", "content")


def usable_pages(pages: DataFrame, html: str = "html", least: int = 200, most: int = 4_000_000) -> DataFrame:
    """Pages whose size a reader accepts."""
    return pages.where(F.length(html).between(least, most))


def query_batches(accounts: DataFrame, order: str, size: int = 6, prefix: str = "from:") -> DataFrame:
    """Account names in batches of `size`, as OR queries: batch, query. Batches follow the order's number."""
    return (
        accounts.withColumn("batch", F.floor(F.col(order) / size).cast("int"))
        .groupBy("batch")
        .agg(F.array_sort(F.collect_list(F.struct(order, "username"))).alias("a"))
        .select("batch", F.array_join(F.transform("a", lambda x: F.concat(F.lit(prefix), x["username"])), " OR ").alias("query"))
    )


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_split(rows: DataFrame, status: str, root: str) -> None:
    """One folder per status, from one pass over rows: partitioned Parquet. Rows without a status are under review."""
    rows.withColumn(status, F.coalesce(F.col(status), F.lit("review"))).write.mode("overwrite").partitionBy(status).parquet(root)


#: What stores and products don't show in public.
PRIVATE_STORE_KEYS = ("sourceUrl", "sourceName", "verificationStatus")
PRIVATE_PRODUCT_KEYS = ("source", "sourceUrl", "imageSource", "imageSourceUrl", "imageSourceType", "sourceFingerprint", "imageInfo", "lastSeenAt", "discoveredAt")
PRIVATE_FEED_KEYS = (
    "sourceUrl", "sourceType", "sourceKind", "sourceKinds", "intelligenceSource", "privateSources", "evidenceCount", "destinationHost", "destinationVerified", "destinationVerificationReason", "verificationChecks", "rawApplyText",
    "rawResultText", "xAuthor", "xPostId",
)


def public_tables(feed: DataFrame, stores: DataFrame, products: DataFrame, blocked: list[str], url_col: str = "url") -> dict[str, DataFrame]:
    """What is published: the feed without records whose address leads to a blocked host or below one, stores and products, each without its private columns."""
    host = urls.host(F.col(url_col))
    shown = feed.where((host == "") | ~urls.host_under(host, blocked))
    return {"feed": shown.drop(*PRIVATE_FEED_KEYS), "stores": stores.drop(*PRIVATE_STORE_KEYS), "products": products.drop(*PRIVATE_PRODUCT_KEYS)}


def write_public(tables: dict[str, DataFrame], root: str) -> None:
    """A folder of JSON for each table; each is written aside first, so a reader of root/<name> sees a whole one or none."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{root}/.next/{name}")
        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(path(f"{root}/{name}"), True)
        files.rename(path(f"{root}/.next/{name}"), path(f"{root}/{name}"))


def write_run(decided: DataFrame, root: str, state: DataFrame, status: str = "status", source: str = "sourceKind") -> None:
    """The five outputs of a run, from one pass over what the gate decided: root/records in folders feed (published), review and rejected
    (status=...), root/status (counts by source), root/quality (counts by status), root/state."""
    spark = decided.sparkSession
    marked = decided.withColumn(status, F.coalesce(F.col(status), F.lit("review")))
    marked.write.mode("overwrite").partitionBy(status).parquet(f"{root}/records")
    written = spark.read.parquet(f"{root}/records")
    count = lambda s: F.count_if(F.col(status) == s).alias(s)
    written.groupBy(source).agg(F.count("*").alias("candidates"), count("published"), count("review"), count("rejected")).write.mode("overwrite").json(f"{root}/status")
    written.agg(F.count("*").alias("candidates"), count("published"), count("review"), count("rejected")).write.mode("overwrite").json(f"{root}/quality")
    state.write.mode("overwrite").parquet(f"{root}/state")


def write_version(rows: DataFrame, root: str, expected: int) -> int:
    """Puts rows in root as version expected + 1, or raises versions.Conflict if it has another newest version than `expected`. See versions for keyed tables."""
    from harrow.sources.versions import Conflict, VersionedTable

    key = rows.columns[0]
    table = VersionedTable(rows.sparkSession, root, key, key, tries=1)
    if table.version() != expected:
        raise Conflict(f"{root}: a version after {expected} already exists, or {expected} does not")
    return table.change(lambda old, deleted: (rows, rows.select(key, F.lit(None).cast("timestamp").alias("deleted_at")).where("false")))


def encode_payload(rows: DataFrame) -> DataFrame:
    """Each row as base64 of its JSON: payload."""
    return rows.select(F.base64(F.encode(F.to_json(F.struct(*rows.columns)), "UTF-8")).alias("payload"))


def decode_payload(rows: DataFrame, schema: T.StructType | str, col: str = "payload") -> DataFrame:
    return rows.select(F.from_json(F.decode(F.unbase64(col), "UTF-8"), schema).alias("r")).select("r.*")
