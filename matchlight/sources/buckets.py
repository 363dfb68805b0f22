"""A keyed table in bucket folders, of which an upsert rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlight.operators.changes import upsert
from matchlight.sources.tables import VersionedTable

BUCKETS = 256
MANIFEST = "bucket int, version bigint, folder string"


class BucketTable:
    """Rows by a hash of ``bucket_by`` in folders ``data/v=<version>/bucket=<n>``.

    A manifest per version says which folder holds each bucket now. A write puts new folders beside the old ones
    and then its manifest; readers take the last manifest that is complete, so they see the version before or the
    one after, whole. A write that failed leaves folders no manifest names; writing that version again replaces them.

    ``bucket_by`` is a part of ``keys``: rows of one player, say, are then in one bucket. Choose the
    number of buckets so that a bucket is a few hundred megabytes; it is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bucket_by: list[str] | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = keys
        self.bucket_by = bucket_by or keys
        self.buckets = buckets
        self.manifests = VersionedTable(spark, f"{self.path}/manifests")

    def bucket(self):
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def manifest(self, before: int | None = None) -> list[tuple[int, int, str]]:
        """(bucket, version, folder) as of the last version, or the last before a given one: a row per bucket."""
        now = self.manifests.latest(before)
        if now is None:
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.manifests.path}/v={now}").collect()
        return sorted((r.bucket, r.version, r.folder) for r in rows)

    def _save(self, rows: DataFrame, version: int) -> list[tuple[int, int, str]]:
        """Write rows into new folders, one file for each bucket; gives the buckets written."""
        root = f"{self.path}/data/v={version}"
        placed = rows.withColumn("bucket", self.bucket())
        placed.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", *self.bucket_by).write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).partitionBy("bucket").parquet(root)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        files = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
        names = [f.getPath().getName() for f in files]
        return [(int(n[7:]), version, f"v={version}/{n}") for n in names if n.startswith("bucket=")]

    def _publish(self, entries: list[tuple[int, int, str]], version: int) -> None:
        self.manifests.write(self.spark.createDataFrame(sorted(entries), MANIFEST).coalesce(1), version)

    def create(self, rows: DataFrame, version: int) -> None:
        """The table is exactly ``rows`` from this version on."""
        self._publish(self._save(rows, version), version)

    def upsert(self, incoming: DataFrame, version: int) -> int:
        """Replace rows with the keys of ``incoming``, add the others; gives the number of buckets rewritten.

        ``incoming`` has a row per key. It must not change while this runs, so store it first if it is costly or
        reads this table.
        """
        current = self.manifest(before=version)
        touched = {r[0] for r in incoming.select(self.bucket()).distinct().collect()}
        if not touched:
            self._publish(current, version)
            return 0
        old = self._read([e for e in current if e[0] in touched], incoming)
        written = self._save(upsert(old, incoming, self.keys), version)
        self._publish([e for e in current if e[0] not in touched] + written, version)
        return len(touched)

    def _read(self, entries: list[tuple[int, int, str]], like: DataFrame | None = None) -> DataFrame:
        if not entries:
            return like.limit(0)
        paths = [f"{self.path}/data/{folder}" for _, _, folder in entries]
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(*paths)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table as of the last version, or the last before a given one; None if there is none."""
        entries = self.manifest(before)
        return self._read(entries) if entries else None

    def vacuum(self, keep_from: int) -> None:
        """Delete the folders that no manifest from ``keep_from`` on names, and the manifests before it."""
        hadoop, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        versions = [v for v in self.manifests._finished() if v >= keep_from]
        used = {folder for v in versions for _, _, folder in self.manifest(v + 1)}
        root = hadoop.Path(f"{self.path}/data")
        files = root.getFileSystem(conf)
        for version in files.listStatus(root):
            name = version.getPath().getName()
            if int(name[2:]) > max(versions, default=keep_from):
                continue  # being written
            for bucket in files.listStatus(version.getPath()):
                if bucket.isDirectory() and f"{name}/{bucket.getPath().getName()}" not in used:
                    files.delete(bucket.getPath(), True)
        for v in self.manifests._finished():
            if v < keep_from:
                files.delete(hadoop.Path(f"{self.manifests.path}/v={v}"), True)
