"""Words and rows shared by the text operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SENT: set[str] = set()  # applications that have the code

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text (runs without ASCII white space); NULL has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES, -1)
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words ``words`` gives, without building them twice."""
    return F.size(words(text))


def byte_words(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) UTF-8 words of a text, for use inside tasks."""
    return (text or "").encode().lower().split()


def remainder(column: str, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def prepare(spark: SparkSession, rows: int = 500) -> None:
    """Make a session ready for functions that run in Python workers.

    Bounds the rows of an Arrow batch, as texts may be long (the setting is read when a plan runs,
    so it stays; a smaller one is left as it is), and sends this package to the workers once.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="matchlight-code-")) / "matchlight_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((root / "matchlight").rglob("*.py")):
                out.write(file, file.relative_to(root))
        context.addPyFile(str(archive))
        _SENT.add(context.applicationId)


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str], weight: Callable[[pd.DataFrame], int], enough: int):
    """Frames of a partition sorted by ``keys``, cut anew so that no group is in two of them.

    Rows are gathered until their weight is ``enough``; the last group is held back, as it may go on.
    """
    held: list[pd.DataFrame] = []
    total = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        total += weight(frame)
        if total < enough:
            continue
        whole = pd.concat(held, ignore_index=True)
        tail = whole[keys].iloc[-1]
        last = int((whole[keys] == tail).all(axis=1).to_numpy().argmax())
        held = [whole.iloc[last:]]
        total = 0  # a group that is enough by itself is looked at again after as many rows
        if last:
            yield whole.iloc[:last].reset_index(drop=True)
    if held:
        yield pd.concat(held, ignore_index=True)


def with_fields(df: DataFrame, column: Column, run: Callable, fields: str) -> DataFrame:
    """The columns of ``df`` and the fields that ``run`` makes of a column, batch by batch.

    ``run`` takes an iterator of series and gives an iterator of frames. Other columns stay in the JVM, so ids are neither
    changed nor lost when some are NULL.
    """

    def batches(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(values)

    made = df.withColumn("made_fields", F.pandas_udf(batches, fields)(column))
    return made.select(*df.columns, "made_fields.*")
