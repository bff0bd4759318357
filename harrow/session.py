"""Session for local use and tests; on a cluster pass your own session to every function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("harrow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Narrow rows of which each is much work, in several tasks for each core: a small file is otherwise one task, however many cores there are."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def pinned(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with these columns, each worked out once a row. Spark moves a filter on a plain column before the column and writes its expression
    into it, as often as the filter names it; one on what a generator gives stays behind it."""
    rest = [c for c in rows.columns if c not in columns]
    return rows.select(*rest, F.inline(F.array(F.struct(*[v.alias(c) for c, v in columns.items()]))))
