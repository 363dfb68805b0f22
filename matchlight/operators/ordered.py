"""Running totals and exact quantiles over a whole table or large groups.

A window without a partition would send everything to one task. Here values are combined first,
then cut into value ranges of about equal size; each range is summed, the few range totals are
accumulated, and a window inside each range adds the rest.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlight.functions.numbers import exact, rounded
from matchlight.session import stored

RANGES = 256


def with_ranges(values: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """Add ``_range``: the index of the value range, ascending with ``order``.

    The cut points are at most ``ranges`` numbers, estimated once and then fixed, so every later
    stage sees the same ranges.
    """
    numeric = values.withColumn("_order", F.col(order).cast("double"))
    points = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(numeric.approxQuantile("_order", points, 1 / (2 * ranges))))
    splits = [float("-inf"), *cuts, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="_order", outputCol="_range")
    return cutter.transform(numeric).drop("_order")


def accumulate(
    values: DataFrame, groups: list[str], order: list, sums: list[str], descending: bool = False
) -> DataFrame:
    """Running and total sums per group for rows that carry a ``_range`` column.

    Adds ``<name>_upto`` (this row included) and ``<name>_total`` for every column in ``sums``.
    """
    range_order = F.desc("_range") if descending else F.asc("_range")
    totals = values.groupBy(*groups, "_range").agg(
        *[F.sum(c).cast("bigint").alias(f"_{c}") for c in sums]
    )
    across = Window.partitionBy(*groups)
    before = across.orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups,
        "_range",
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in sums],
        *[F.sum(f"_{c}").over(across).alias(f"{c}_total") for c in sums],
    )
    inside = (
        Window.partitionBy(*groups, "_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = values.join(offsets, [*groups, "_range"])
    return joined.withColumns(
        {f"{c}_upto": (F.col(f"_{c}_before") + F.sum(c).over(inside)).cast("bigint") for c in sums}
    ).drop("_range", *[f"_{c}_before" for c in sums])


def exact_quantiles(
    df: DataFrame,
    groups: list[str],
    value,
    probabilities: dict[str, float],
    digits: int = 6,
    ranges: int = RANGES,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    ``probabilities`` maps output column names to probabilities. The counts per value are stored,
    so the input is read once.
    """
    keys = groups or ["_all"]
    base = df if groups else df.withColumn("_all", F.lit(1))
    counts = (
        base.select(*keys, exact(value).alias("_v"))
        .filter("_v is not null")
        .groupBy(*keys, "_v")
        .agg(F.count("*").alias("n"))
    )
    ranged = with_ranges(stored(counts, "value-counts"), "_v", ranges)
    ranked = accumulate(ranged, keys, [F.asc("_v")], ["n"])

    def at(position):
        inside = (F.col("n_upto") - F.col("n") <= position) & (position < F.col("n_upto"))
        return F.max(F.when(inside, F.col("_v"))).cast("double")

    columns = []
    for name, p in probabilities.items():
        where = F.lit(p) * (F.col("n_total") - 1)
        low, high = at(F.floor(where)), at(F.ceil(where))
        share = F.max(where - F.floor(where))
        columns.append(rounded(low + (high - low) * share, digits).alias(name))
    result = ranked.groupBy(*keys).agg(*columns)
    return result if groups else result.drop("_all")
