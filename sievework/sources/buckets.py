"""Keyed tables in buckets: an update rewrites the buckets it touches, then moves one pointer.

``data/version=N/bucket=B`` holds the rows of a bucket as of version N, ``pointer/version=N`` the version every
bucket was last written in.  A version is committed with its pointer, so a reader sees all of it
or nothing, and repeating version N starts from the versions before it and ends in the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed ``version=N`` folders, oldest first."""
    root, store = _folder(spark, path)
    if not store.exists(root):
        return []
    names = [entry.getPath() for entry in store.listStatus(root)]
    done = lambda p: store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(
        int(p.getName().removeprefix("version=")) for p in names if p.getName().startswith("version=") and done(p)
    )


class BucketTable:
    """Rows that are unique by ``keys``, dealt to ``buckets`` by a hash of ``by`` (some of the keys).

    ``before`` hides the versions from that one on: a batch that is repeated reads what it read first.
    The pointer has one row per bucket that was ever written: fixed in size by ``buckets``.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, keys: list[str], by: list[str] | None = None,
        buckets: int = 64, before: int | None = None,
    ):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.by, self.buckets = by or keys, buckets
        known = [v for v in versions(spark, f"{path}/pointer") if before is None or v < before]
        self.version = known[-1] if known else None
        self.pointer: dict[int, int] = {}
        if known:
            rows = spark.read.schema("bucket int, written long").parquet(f"{path}/pointer/version={known[-1]}")
            self.pointer = {r.bucket: r.written for r in rows.collect()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of ``rows``, which has the columns ``by``; at most ``buckets`` numbers."""
        return [r[0] for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]

    def read(self, only: list[int] | None = None) -> DataFrame:
        """Rows of all buckets, or of some: the files of others are not opened."""
        wanted = self.pointer if only is None else [b for b in only if b in self.pointer]
        folders = [f"{self.path}/data/version={self.pointer[b]}/bucket={b}" for b in wanted]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows whose ``by`` columns are among those of ``wanted``."""
        asked = wanted.select(*self.by).distinct()
        return self.read(self.touched(asked)).join(asked, self.by, "left_semi")

    def merge(self, version: int, changes: DataFrame, removed: DataFrame | None = None) -> list[int]:
        """Write ``changes`` over the rows of their keys, without those of ``removed``, as ``version``; returns the
        buckets written.  ``changes`` has each key once."""
        rows = changes.select(*self.spark.createDataFrame([], self.schema).columns)
        gone = rows.select(*self.keys) if removed is None else rows.select(*self.keys).unionByName(removed.select(*self.keys))
        only = self.touched(gone)
        kept = self.read(only).join(gone.distinct(), self.keys, "left_anti")
        out = kept.unionByName(rows).withColumn("bucket", self.bucket())
        data = f"{self.path}/data/version={version}"
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        folder, store = _folder(self.spark, data)
        written = [b for b in only if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"bucket={b}"))]
        pointer = {b: v for b, v in self.pointer.items() if b not in only} | dict.fromkeys(written, version)
        table = self.spark.createDataFrame(sorted(pointer.items()), "bucket int, written long")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointer/version={version}")
        return only

    def vacuum(self) -> None:
        """Remove what neither this version nor a later one needs: older pointers, and bucket folders that
        this version's pointer does not name.  Call before ``merge``, so the version before it stays readable."""
        if self.version is None:
            return
        for old in versions(self.spark, f"{self.path}/pointer"):
            if old < self.version:
                folder, store = _folder(self.spark, f"{self.path}/pointer/version={old}")
                store.delete(folder, True)
        root, store = _folder(self.spark, f"{self.path}/data")
        for entry in store.listStatus(root):
            number = int(entry.getPath().getName().removeprefix("version="))
            if number > self.version:
                continue
            inside = [p.getPath() for p in store.listStatus(entry.getPath()) if p.getPath().getName().startswith("bucket=")]
            live = {b for b, v in self.pointer.items() if v == number}
            for folder in inside:
                if int(folder.getName().removeprefix("bucket=")) not in live:
                    store.delete(folder, True)
            if not live:
                store.delete(entry.getPath(), True)
