"""Session settings and the durable scratch area."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from pathlib import Path
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# SQL settings every job relies on. Join and shuffle sizing is left to adaptive execution: a side
# is broadcast only when its measured size is under the threshold, partitions are merged or split
# to the advisory size, and a hot join key is split even when that costs one more shuffle.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(
    app_name: str = "matchlight",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above.

    ``shuffle_partitions`` is the starting count; adaptive execution merges small ones, so on a
    cluster give it a few times the total core count and leave it there.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SQL_SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the folder named in ``spark.checkpoint.dir``. Only a local session may fall back to a
    fresh temporary folder, because on a cluster other machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="matchlight-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For a table several later passes read: it is computed once, its lineage ends here, and losing
    an executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path no other run uses, inside this application's part of the shared folder."""
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()  # applications whose workers have the code


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder made with :func:`scratch_path` that nothing reads any more."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the workers once, for functions that run there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="matchlight-package-")) / "matchlight_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "matchlight").rglob("*.py")):
            if "llm" not in file.parts:
                out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def side_by_side(spark: SparkSession, tasks: list[Callable[[], Any]], most: int) -> list:
    """The results of some functions, in their order; up to ``most`` submit their Spark jobs at the same time.

    Training is many short jobs one after the other, which alone leave most of a cluster idle.
    """
    ship_code(spark)
    shared_dir(spark)
    if len(tasks) < 2:
        return [task() for task in tasks]
    with ThreadPool(min(most, len(tasks))) as pool:
        return pool.map(lambda task: task(), list(map(inheritable_thread_target(spark), tasks)), chunksize=1)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application stored with :func:`stored` and :func:`scratch_path`."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(context._jsc.hadoopConfiguration()).delete(root, True)


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/matchlight-{spark.sparkContext.applicationId}"
