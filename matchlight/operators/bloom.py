"""Bloom filters as tables of 64-bit words, in SQL functions.

All bits of a key lie in one word, so looking a key up is an equi-join on the word, and building a filter is a
group that combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 5  # set per key
# Words of a filter made to be broadcast: 2^18 rows of 16 bytes at most, whatever the number of keys. More keys
# than it can tell apart let more rows through; none is lost.
SMALL_WORDS = 18
LISTED = 1000  # keys that may stand in a plan


def word_of(key: Column, log_words) -> Column:
    """The word a key's bits are in."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), log_words)
    return F.xxhash64(key, F.lit("word")).bitwiseAND(size - 1)


def mask_of(key: Column) -> Column:
    """The key's bits in its word: the positions are six bits each of one hash."""
    hashed = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("bigint")
    for i in range(BITS):
        at = F.shiftright(hashed, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return mask


def words(keys: DataFrame, key: str, log_words: int) -> DataFrame:
    """(word, bits): the filter of a column; NULL keys are not in it."""
    some = keys.where(F.col(key).isNotNull())
    return some.groupBy(word_of(F.col(key), F.lit(log_words)).alias("word")).agg(F.bit_or(mask_of(F.col(key))).alias("bits"))


def holds(bits: Column, key: Column) -> Column:
    mask = mask_of(key)
    return F.coalesce(bits.bitwiseAND(mask) == mask, F.lit(False))


def listed(keys: DataFrame, key: str, most: int = LISTED) -> list | None:
    """The distinct values of a column if there are at most ``most``, else None; reads no more of them."""
    values = [r[0] for r in keys.where(F.col(key).isNotNull()).select(key).distinct().limit(most + 1).collect()]
    return values if len(values) <= most else None


def narrowed(df: DataFrame, columns: list[str], keys: DataFrame, key: str, values: list | None) -> DataFrame:
    """The rows of which one of ``columns`` may be among the keys.

    A short list of values (see :func:`listed`) goes into the scan, where footers of row groups are compared with it; beyond that a
    filter is broadcast.
    """
    if values is None:
        return may_match(df, columns, keys, key)
    kept = F.lit(False)
    for column in columns:
        kept = kept | F.col(column).isin(values)
    return df.where(kept)


def may_match(df: DataFrame, columns: list[str], keys: DataFrame, key: str, log_words: int = SMALL_WORDS) -> DataFrame:
    """The rows of which one of ``columns`` may be among the keys; a few others stay, too.

    The filter is broadcast, its size is fixed, and rows are dropped in the task that reads them.
    """
    return marked(df, columns, keys, key, "_kept", log_words).where("_kept").drop("_kept")


def marked(df: DataFrame, columns: list[str], keys: DataFrame, key: str, name: str, log_words: int = SMALL_WORDS) -> DataFrame:
    """Add ``name``: whether one of ``columns`` may be among the keys; false is certain. The filter is that of ``may_match``."""
    filtered = F.broadcast(words(keys, key, log_words))
    kept = F.lit(False)
    for i, column in enumerate(columns):
        side = filtered.select(F.col("word").alias(f"_word{i}"), F.col("bits").alias(f"_bits{i}"))
        df = df.join(side, word_of(F.col(column), F.lit(log_words)) == F.col(f"_word{i}"), "left")
        kept = kept | holds(F.col(f"_bits{i}"), F.col(column))
    return df.withColumn(name, kept).drop(*[f"_{n}{i}" for i in range(len(columns)) for n in ("word", "bits")])
