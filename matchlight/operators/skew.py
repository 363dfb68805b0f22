"""A join that spreads hot keys over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more fact rows than this is split into pieces of about this size.
ROWS_PER_TASK = 5_000_000
# Rows without a key match nothing; a left join keeps them and spreads them this far.
NULL_PIECES = 1024


def hot_keys(facts: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows and the number of pieces each needs.

    Counting combines before its shuffle. At most total rows / ``rows_per_task`` keys qualify,
    which is what makes the result safe to broadcast.
    """
    return (
        facts.groupBy(key)
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > rows_per_task)
        .select(key, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_pieces"))
    )


def skew_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    spread_by: str,
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Join facts to a dimension on ``key`` without any task getting all rows of one key.

    Fact rows of a hot key are dealt to its pieces by a hash of ``spread_by``; only the dimension
    rows of hot keys are repeated, once per piece. ``how`` is inner or left. Hot keys are counted
    on ``keys_from``, an earlier and cheaper table with the same key column, if given.
    """
    counted = facts if keys_from is None else keys_from
    hot = F.broadcast(hot_keys(counted, key, rows_per_task))
    hashed = F.xxhash64(spread_by)
    piece = F.when(F.col(key).isNull(), F.pmod(hashed, F.lit(NULL_PIECES))).otherwise(
        F.coalesce(F.pmod(hashed, F.col("_pieces")), F.lit(0))
    )
    dealt = facts.join(hot, key, "left").withColumn("_piece", piece.cast("int"))
    repeated = (
        dim.join(hot, key, "left")
        .withColumn(
            "_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces") - 1, F.lit(0))))
        )
        .drop("_pieces")
    )
    return dealt.drop("_pieces").join(repeated, [key, "_piece"], how).drop("_piece")


def mark_members(
    facts: DataFrame, ids: DataFrame, key: str, flag: str, spread_by: str, **extra
) -> DataFrame:
    """Add a boolean column: whether ``key`` occurs in the one-column table ``ids``."""
    members = ids.toDF(key).withColumn(flag, F.lit(True))
    marked = skew_join(facts, members, key, spread_by, "left", **extra)
    return marked.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
