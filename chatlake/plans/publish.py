"""Batches of table changes that are put in place together.

A writer stages everything it wants to change under ``<root>/_pending/<id>``:

    append/<table>       files to be added to the table's folder
    replace/<table>      a folder that takes the place of the table's
    buckets/<table>/...  bucket folders that take the place of the table's

and then a ``_ready`` marker.  Publishing is renames only, each of which can be
repeated: what has left the batch is in place.  So after a crash the batch is
either not ready, and nothing of it is seen, or ``recover`` finishes it; every
open of an archive and every write does that first.  A reader that is in the
middle of its own read when a batch is published may miss files, as with any
Parquet folder.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PENDING, READY = "_pending", "_ready"

#: Number of buckets of a table that is upserted by key; the folders' names carry it.
BUCKETS = 64
_BUCKET = re.compile(r"bucket(\d+)=")


class Folder:
    """Listing, renaming and deleting through Hadoop's file system, whatever the scheme."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return bool(self.fs.exists(self.path(p)))

    def names(self, p: str) -> list[str]:
        """Entries of a folder without Spark's hidden ones, sorted; none if it is missing."""
        if not self.exists(p):
            return []
        found = (s.getPath().getName() for s in self.fs.listStatus(self.path(p)))
        return sorted(n for n in found if not n.startswith((".", "_")))

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"could not rename {a} to {b}")

    def make(self, p: str) -> None:
        self.fs.mkdirs(self.path(p))

    def touch(self, p: str) -> None:
        self.fs.create(self.path(p), True).close()

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


def bucket_count(spark: SparkSession, path: str) -> int | None:
    """Buckets of a stored table; None if it is missing or has none."""
    found = (_BUCKET.match(n) for n in Folder(spark, path).names(path))
    return next((int(m[1]) for m in found if m), None)


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Batch:
    """Changes to the tables of one archive; nothing is seen before ``publish``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.base = f"{self.root}/{PENDING}/{uuid.uuid4().hex}"

    def _stage(self, df: DataFrame, action: str, table: str, by: str | None = None) -> DataFrame:
        path = f"{self.base}/{action}/{table}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def append(self, table: str, df: DataFrame) -> DataFrame:
        return self._stage(df, "append", table)

    def replace(self, table: str, df: DataFrame) -> DataFrame:
        return self._stage(df, "replace", table)

    def upsert(self, table: str, rows: DataFrame, key: str) -> tuple[DataFrame, str, str]:
        """Rows by key into a bucketed table; only the buckets of the new keys are read and written.

        ``rows`` has one row per key and may not be a lazy read of the table.  A
        table without buckets is laid out in buckets once.  Returns what was
        staged, its action and the bucket column.
        """
        path = f"{self.root}/{table}"
        stored = Folder(self.spark, self.root).names(path)
        n = bucket_count(self.spark, path)
        by, action = f"bucket{n or BUCKETS}", "buckets" if n else "replace"
        rows = rows.withColumn(by, bucket_of(key, n or BUCKETS))
        if stored:
            old = self.spark.read.parquet(path)
            if n:
                # Bounded by the number of buckets.
                touched = [r[0] for r in rows.select(by).distinct().collect()]
                old = old.where(F.col(by).isin(touched))
            else:
                old = old.withColumn(by, bucket_of(key, BUCKETS))
            kept = old.select(*rows.columns).join(rows.select(key), key, "left_anti").select(*rows.columns)
            rows = kept.unionByName(rows)
        return self.bucketed(table, rows.repartition(by), action, by), action, by

    def bucketed(self, table: str, rows: DataFrame, action: str, by: str) -> DataFrame:
        """Whole buckets of a table: in place of its folder, or of the buckets of the same name."""
        return self._stage(rows, action, table, by)

    def publish(self) -> None:
        """Mark the batch as ready and put it in place."""
        folder = Folder(self.spark, self.root)
        folder.make(self.base)
        folder.touch(f"{self.base}/{READY}")
        _finish(folder, self.root, self.base)


def _swap(folder: Folder, new: str, place: str, old: str) -> None:
    if folder.exists(place):
        folder.make(old.rpartition("/")[0])
        folder.delete(old)
        folder.rename(place, old)
    folder.rename(new, place)


def _finish(folder: Folder, root: str, base: str) -> None:
    for table in folder.names(f"{base}/append"):
        folder.make(f"{root}/{table}")
        for name in folder.names(f"{base}/append/{table}"):
            folder.rename(f"{base}/append/{table}/{name}", f"{root}/{table}/{name}")
    for table in folder.names(f"{base}/replace"):
        _swap(folder, f"{base}/replace/{table}", f"{root}/{table}", f"{base}/_old/{table}")
    for table in folder.names(f"{base}/buckets"):
        for name in folder.names(f"{base}/buckets/{table}"):
            _swap(folder, f"{base}/buckets/{table}/{name}", f"{root}/{table}/{name}", f"{base}/_old/{table}.{name}")
    folder.delete(base)


def recover(spark: SparkSession, root: str) -> int:
    """Finish the ready batches of an archive; returns how many there were."""
    root = root.rstrip("/")
    folder, done = Folder(spark, root), 0
    for name in folder.names(f"{root}/{PENDING}"):
        base = f"{root}/{PENDING}/{name}"
        if folder.exists(f"{base}/{READY}"):
            _finish(folder, root, base)
            done += 1
    return done


def discard(spark: SparkSession, root: str) -> int:
    """Delete batches that are not ready (of writers that have crashed; no writer may be at work)."""
    root = root.rstrip("/")
    folder, done = Folder(spark, root), 0
    for name in folder.names(f"{root}/{PENDING}"):
        if not folder.exists(f"{root}/{PENDING}/{name}/{READY}"):
            folder.delete(f"{root}/{PENDING}/{name}")
            done += 1
    return done
