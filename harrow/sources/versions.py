"""A keyed table in numbered versions: upserts and deletes by several writers at once, none lost.

A version is a folder of rows and tombstones, and a commit file that names it. The commit file of a
version is created by one writer only, as creating it is atomic and fails where it exists; who comes second reads the
newer version, applies its change to that, and tries again. Readers see whole versions: what isn't
committed has no commit file.

Files: root/data/<id>/rows and .../deleted (Parquet), root/commits/<version, 20 digits>. On local
disks the commit is a hard link, elsewhere a rename that doesn't overwrite (HDFS and what behaves like it).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOMBSTONE = "deleted_at"


class Conflict(RuntimeError):
    """Every try met a newer version."""


class VersionedTable:
    """Rows by `key` (a column), with `stamp` (a column, e.g. updatedAt) telling which of two rows is newer. tombstones: as many deleted keys as
    are remembered, the newest, then by key; those of one time stay whole until `repair`, so that of many keys deleted at once the ones that come
    back don't cost others their place. Null keys are refused by upsert and delete: such rows are left out."""

    def __init__(self, spark: SparkSession, root: str, key: str, stamp: str, tombstones: int = 500, tries: int = 3):
        self.spark, self.root, self.key, self.stamp, self.tombstones, self.tries = spark, root.rstrip("/"), key, stamp, tombstones, tries
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    # ---- reading

    def version(self) -> int:
        """The newest version; 0 before the first."""
        folder = self._path("commits")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def _data(self, version: int) -> str:
        stream = self._fs.open(self._path(f"commits/{version:020d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version (the newest by default); None before the first."""
        version = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.root}/data/{self._data(version)}/rows") if version else None

    def deleted(self, version: int | None = None) -> DataFrame | None:
        """Tombstones of a version, the newest `tombstones` of them: the key, deleted_at."""
        version = self.version() if version is None else version
        return self._remembered(self._all_deleted(version)) if version else None

    def _all_deleted(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/{self._data(version)}/deleted")

    def _remembered(self, deleted: DataFrame) -> DataFrame:
        return deleted.orderBy(F.desc(TOMBSTONE), self.key).limit(self.tombstones)

    def _not_older(self, deleted: DataFrame) -> DataFrame:
        """Without those older than the last that is remembered."""
        last = self._remembered(deleted).agg(F.when(F.count(TOMBSTONE) == self.tombstones, F.min(TOMBSTONE)).alias("_last"))
        return deleted.join(F.broadcast(last), F.col("_last").isNull() | (F.col(TOMBSTONE) >= F.col("_last"))).drop("_last")

    # ---- writing

    def _claim(self, version: int, data: str) -> bool:
        """Whether the commit file of the version was created by this call."""
        drafts, target = f"drafts/{data}", f"commits/{version:020d}"
        for folder in ("drafts", "commits"):
            self._fs.mkdirs(self._path(folder))
        out = self._fs.create(self._path(drafts), True)
        out.write(bytearray(data.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                local = lambda name: self.spark._jvm.java.io.File(self._path(name).toUri().getPath()).toPath()
                from py4j.protocol import Py4JJavaError

                try:
                    self.spark._jvm.java.nio.file.Files.createLink(local(target), local(drafts))
                    return True
                except Py4JJavaError as e:
                    if "FileAlreadyExists" in str(e.java_exception):
                        return False
                    raise
            return bool(self._fs.rename(self._path(drafts), self._path(target)))
        finally:
            if self._fs.exists(self._path(drafts)):
                self._fs.delete(self._path(drafts), False)

    def change(self, apply: Callable[[DataFrame | None, DataFrame | None], tuple[DataFrame, DataFrame]]) -> int:
        """Writes the version that `apply` makes of the newest rows and tombstones (None before the first); applies it anew where another
        writer was faster, `tries` times in all, then raises Conflict. Returns the version."""
        for attempt in range(self.tries):
            version = self.version()
            rows, deleted = apply(self.read(version) if version else None, self._all_deleted(version) if version else None)
            data = uuid.uuid4().hex
            rows.write.parquet(f"{self.root}/data/{data}/rows")
            self._not_older(deleted.groupBy(self.key).agg(F.max(TOMBSTONE).alias(TOMBSTONE))).write.parquet(f"{self.root}/data/{data}/deleted")
            if self._claim(version + 1, data):
                return version + 1
            self._fs.delete(self._path(f"data/{data}"), True)
            time.sleep(0.05 * (attempt + 1))
        raise Conflict(f"{self.tries} tries met newer versions of {self.root}")

    def _none(self, rows: DataFrame) -> DataFrame:
        return rows.select(self.key, F.lit(None).cast("timestamp").alias(TOMBSTONE)).where("false")

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row for each key: the newest; columns that it has null come from the next newer one that has them."""
        others = [c for c in rows.columns if c not in (self.key, self.stamp)]
        place = F.struct(F.col(self.stamp), F.struct(*others) if others else F.lit(0))
        known = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in others]
        return rows.groupBy(self.key).agg(*known, F.max(self.stamp).alias(self.stamp)).select(*rows.columns)

    def upsert(self, rows: DataFrame) -> int:
        """Puts rows in the place of those with their keys; of several with one key the newest. Their tombstones go."""
        new = rows.where(F.col(self.key).isNotNull())
        own = self._newest(new)

        def apply(old: DataFrame | None, deleted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
            keys = own.select(self.key)
            kept = own if old is None else old.join(keys, self.key, "left_anti").unionByName(own, allowMissingColumns=True)
            return kept, self._none(own) if deleted is None else deleted.join(keys, self.key, "left_anti")

        return self.change(apply)

    def delete(self, keys: DataFrame, at) -> int:
        """Takes out the rows with these keys and remembers the keys, deleted `at` (a timestamp Column), whether they were there or not."""
        gone = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()

        def apply(old: DataFrame | None, deleted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
            if old is None:
                raise ValueError("nothing to delete from: the table has no version yet")
            marks = gone.withColumn(TOMBSTONE, at.cast("timestamp"))
            return old.join(gone, self.key, "left_anti"), deleted.join(gone, self.key, "left_anti").unionByName(marks)

        return self.change(apply)

    def repair(self, refresh: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
        """One row for each key (see _newest), refreshed, again one for each key; tombstones of keys that are there go, and all
        but the newest `tombstones` of the others."""

        def apply(old: DataFrame | None, deleted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
            if old is None:
                raise ValueError("nothing to repair: the table has no version yet")
            rows = self._newest(refresh(self._newest(old.where(F.col(self.key).isNotNull()))))
            return rows, self._remembered(deleted.join(rows.select(self.key), self.key, "left_anti"))

        return self.change(apply)

    def forget(self, keep: int = 10) -> None:
        """Deletes the data of all but the newest `keep` versions; their commit files stay, so that numbers aren't used again."""
        for version in range(1, self.version() - keep + 1):
            folder = self._path(f"data/{self._data(version)}")
            if self._fs.exists(folder):
                self._fs.delete(folder, True)
