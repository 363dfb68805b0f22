"""Change handling on plain tables: upsert, change keys, append-only history, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` replace those of ``current`` with the same key; new keys are added.

    Keys are unique on both sides, so this is an anti join and a union: the large table moves once
    and nothing is sorted.
    """
    kept = current.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming)


def changed_matches(before: DataFrame, after: DataFrame) -> DataFrame:
    """Matches whose winner or result differs; NULL and a value count as different."""
    old = before.select(
        "match_id", F.col("winner_id").alias("old_winner"), F.col("result").alias("old_result")
    )
    same = F.col("winner_id").eqNullSafe(F.col("old_winner")) & F.col("result").eqNullSafe(
        F.col("old_result")
    )
    return after.join(old, "match_id").filter(~same).select(*after.columns)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose key is not there yet, one per key."""
    return one_of(incoming.join(existing.select(*keys), keys, "left_anti"), keys)


def one_of(rows: DataFrame, keys: list[str], order: list[Column] | None = None, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order`` and then a hash of the row.

    So a task that is run again picks the same row. Rows combine before their shuffle.
    """
    rank = F.struct(*(order or []), F.xxhash64(*rows.columns))
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*rows.columns), rank).alias("_row")).select("_row.*")


def rating_history(scored: DataFrame, as_of, batch_id: int) -> DataFrame:
    """One rating per (player, game) and batch, ready to append."""
    return scored.select(
        "player_id",
        "game_id",
        "rating",
        F.lit(str(as_of)).cast("timestamp_ntz").cast("date").alias("rating_date"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
    )


def propagate(facts: DataFrame, changed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Copy changed dimension values into a denormalised table, keeping the rest as it is."""
    new = changed.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = facts.join(new, key, "left")
    fresh = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(fresh).select(*facts.columns)


def first_seen(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not stored yet, one per key.

    The stored table is first cut to the incoming keys, a join whose small side is the incoming
    batch; only those few keys then meet the batch in the anti join.
    """
    wanted = rows.select(*keys).distinct()
    known = stored.select(*keys).join(wanted, keys, "left_semi")
    return insert_if_absent(known, rows, keys)
