"""Intermediate tables in the folder that the driver and all executors share.

A materialised step cuts lineage: a lost executor costs the tasks it ran, not the
whole plan, and what several branches read is worked out once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Spark's own setting for shuffle files of a finished query.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that Spark's Parquet reader holds decoded at once.
AT_ONCE = "spark.sql.parquet.columnarReaderBatchSize"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where that is unset (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="harrow-")
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone when the process ends
        pass


class Scratch:
    """Tables of one run of an operator; `drop` and `only` free tables early, the rest go when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/harrow-{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(_remove_quietly, spark, self.root)

    def keep(self, df: DataFrame, name: str, codec: str = "snappy", free: bool = False, one_by_one: bool = False) -> DataFrame:
        """Write df as Parquet under the shared folder and read it back. codec: zstd for wide tables that lie there beside large shuffles.
        free: have Spark remove the shuffle files of this write as it ends, not when the driver happens to collect its garbage.
        one_by_one: rows that df reads are megabytes each and have to be decoded singly, not some thousands at once."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        before, at_once = self.spark.conf.get(FREED, "false"), self.spark.conf.get(AT_ONCE)
        self.spark.conf.set(FREED, "true" if free else before)
        self.spark.conf.set(AT_ONCE, "1" if one_by_one else at_once)
        try:
            df.write.mode("overwrite").option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(FREED, before)
            self.spark.conf.set(AT_ONCE, at_once)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.root}/{name}")
            self.names.discard(name)

    def only(self, *names: str) -> None:
        """Free every table but these."""
        self.drop(*(self.names - set(names)))
