"""Readers and sinks for real tables: CSV, parquet, JDBC, append, replace and versioned upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchlight import schemas


def read_stats_csv(spark: SparkSession, path: str) -> DataFrame:
    """The feature export as CSV, with the fixed schema."""
    return spark.read.schema(schemas.FEATURE_CSV).option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema=None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A query against a relational database, read in ranges of a key when bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column and bounds:
        return (
            reader.option("dbtable", f"({query}) q")
            .option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
            .load()
        )
    return reader.option("query", query).load()


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Full refresh: the table holds exactly ``df`` afterwards.

    ``df`` must not read from ``path``; see :class:`VersionedTable` for that case.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """A catalog table bucketed and sorted by a key, at the given path.

    With matches and moves in equally many buckets of ``match_id``, joining them moves no rows.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def append_ratings(ratings: DataFrame, path: str) -> None:
    """Rating history, one folder per date so a date range prunes to its folders."""
    append(ratings, path, ["rating_date"])


class VersionedTable:
    """A parquet table that can be rewritten from itself.

    Each write goes to a new ``v=<number>`` folder named by the writer (a stream's batch id, say);
    readers take the highest folder that finished, marked by its ``_SUCCESS`` file. Writing a
    version again replaces just that folder, so a retried batch has no further effect and a lost
    job leaves the last good version in place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _finished(self) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop
        root = hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v=") and fs.exists(hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append(int(name[2:]))
        return sorted(found)

    def latest(self, before: int | None = None) -> int | None:
        versions = [v for v in self._finished() if before is None or v < before]
        return versions[-1] if versions else None

    def read(self, before: int | None = None) -> DataFrame | None:
        version = self.latest(before)
        if version is None:
            return None
        return self.spark.read.parquet(f"{self.path}/v={version}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
