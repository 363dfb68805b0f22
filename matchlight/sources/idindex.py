"""Which batch folders may hold an id, told from small filters instead of the folders.

Every batch leaves a Bloom filter of its ids and one row that describes it: the filter's size and the first and
last day of its rows. A later batch joins its own ids with the words of the filters and gets
the folders that may hold them; no other folder is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlight.operators import bloom

IDS_PER_WORD = 3  # 21 bits an id: about one id in a thousand that is not there is taken to be
LEAST_WORDS, MOST_WORDS = 4, 40  # as powers of two


class IdIndex:
    """Filters and descriptions under one path, a folder for each batch. Writing a batch again replaces its own."""

    FILTER = "word bigint, bits bigint, size int"
    ABOUT = "rows bigint, size int, low_day date, high_day date"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        schema = f"{schema}, batch_id bigint"
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return df if before is None else df.where(F.col("batch_id") < before)

    def about(self, before: int | None = None) -> DataFrame:
        return self._read("about", self.ABOUT, before)

    def add(self, rows: DataFrame, key: str, batch_id: int, day: str | None = None) -> None:
        """Describe the rows of a batch; ``day`` is their date column, if they have one."""
        days = (F.min(day), F.max(day)) if day else (F.lit(None).cast("date"), F.lit(None).cast("date"))
        n, low, high = rows.agg(F.count(key), *days).first()
        size = min(max(LEAST_WORDS, (max(1, n // IDS_PER_WORD) - 1).bit_length()), MOST_WORDS)
        words = bloom.words(rows, key, size).withColumn("size", F.lit(size))
        words.write.mode("overwrite").parquet(f"{self.path}/filters/batch_id={batch_id}")
        line = self.spark.createDataFrame([(n, size, low, high)], self.ABOUT)
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/about/batch_id={batch_id}")

    def hits(self, ids: DataFrame, key: str, before: int | None = None) -> DataFrame:
        """(key, batch_id): the batches whose filter has each id; ``ids`` has a row per id.

        Filters of equal size are one equi-join, and there are at most as many sizes as powers of two.
        """
        sizes = [r[0] for r in self.about(before).select("size").distinct().collect()]
        if not sizes:
            return ids.select(key).where(F.lit(False)).withColumn("batch_id", F.lit(None).cast("bigint"))
        probes = ids.select(key, F.explode(F.array(*[F.lit(s) for s in sorted(sizes)])).alias("size"))
        probes = probes.withColumn("word", bloom.word_of(F.col(key), F.col("size")))
        found = probes.join(self._read("filters", self.FILTER, before), ["size", "word"])
        return found.where(bloom.holds(F.col("bits"), F.col(key))).select(key, "batch_id")

    def folders(self, ids: DataFrame, key: str, before: int | None = None) -> list[int]:
        """The batches to open for some ids: at most all there are."""
        return sorted(r[0] for r in self.hits(ids, key, before).select("batch_id").distinct().collect())

    def folders_of_days(self, days: DataFrame, day: str, before: int | None = None) -> list[int]:
        """The batches between whose first and last day one of the given days lies."""
        about = self.about(before).where("low_day is not null")
        spans = about.select("batch_id", F.explode(F.sequence("low_day", "high_day")).alias(day))
        return sorted(r[0] for r in spans.join(days.select(day).distinct(), day).select("batch_id").distinct().collect())
