"""Feature building: encodings, imputation, scaling, splits, folds and class weights."""

from __future__ import annotations

from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlight.functions.identifiers import in_train, key_hash
from matchlight.functions.numbers import ratio, rounded
from matchlight.operators.ordered import accumulate

UNKNOWN = "unknown"


def category_vocab(df: DataFrame, columns: list[str]) -> DataFrame:
    """The values of each categorical column plus the value for anything unseen."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns]
    )
    seen = df.select(F.inline(pairs)).distinct()
    extra = seen.select("feature", F.lit(UNKNOWN).alias("value")).distinct()
    return seen.unionByName(extra).distinct()


def label_encode(df: DataFrame, column: str, output: str, strict: bool = True) -> DataFrame:
    """Codes 0..n-1 in alphabetical order; unseen values raise unless ``strict`` is off."""
    return encoder(df, column, output, "error" if strict else "keep").transform(df)


def encoder(df: DataFrame, column: str, output: str, invalid: str = "keep"):
    """Learn the codes from ``df``. With ``keep``, unseen values get the code n."""
    return StringIndexer(
        inputCol=column, outputCol=output, stringOrderType="alphabetAsc", handleInvalid=invalid
    ).fit(df)


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """0/1 columns per value, without the alphabetically first one."""
    index = StringIndexer(
        inputCol=column, outputCol="_index", stringOrderType="alphabetDesc"
    ).fit(df)
    hot = OneHotEncoder(inputCol="_index", outputCol="_hot", dropLast=True)
    indexed = index.transform(df)
    coded = hot.fit(indexed).transform(indexed)
    values = index.labels[:-1]
    array = coded.withColumn("_array", vector_to_array("_hot"))
    columns = {
        f"{column}_{value}": F.get("_array", F.lit(i)).cast("int") for i, value in enumerate(values)
    }
    return array.withColumns(columns).drop("_index", "_hot", "_array")


def numeric_columns(df: DataFrame) -> list[str]:
    """The columns that hold numbers, in table order."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [name for name, kind in df.dtypes if kind.split("(")[0] in numeric]


def impute_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill NULLs with the column mean, by default in every floating-point column."""
    if columns is None:
        columns = [c for c in numeric_columns(df) if dict(df.dtypes)[c] in ("float", "double")]
    model = Imputer(strategy="mean", inputCols=columns, outputCols=columns).fit(df)
    return model.transform(df)


def standard_scale(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Centre each column and divide by its population deviation (0 for a constant column)."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()

    def scaled(c: str) -> Column:
        spread = stats[f"s_{c}"] or 1.0
        return rounded((F.col(c) - F.lit(float(stats[f"m_{c}"]))) / F.lit(float(spread)), digits)

    return df.withColumns({c: scaled(c) for c in columns})


def hash_split(df: DataFrame, key: Column, train_permille: int = 800) -> DataFrame:
    """Mark rows as train or test by a hash of the key, the same on every run."""
    return df.withColumn("is_train", in_train(key, train_permille))


def group_split(df: DataFrame, group: str, train_permille: int = 800):
    """Train and test rows such that all rows of a group are on one side."""
    groups = df.select(group).distinct()
    train = groups.filter(in_train(F.col(group), train_permille))
    return df.join(train, group, "left_semi"), df.join(train, group, "left_anti")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (classes x rows of the class), so every class weighs the same."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return counts.withColumn("_t", totals).select(
        label,
        "n",
        rounded(ratio(F.col("_t.rows"), F.col("_t.classes") * F.col("n")), 6).alias("weight"),
    )


def stratified_folds(df: DataFrame, label: str, keys: list[str], folds: int = 5) -> DataFrame:
    """Deal the rows of each label into folds in hash order, so fold sizes differ by at most one.

    The position within a label comes from running totals over hash ranges, which keeps a label
    with most of the rows spread over many tasks.
    """
    spread = F.pmod(key_hash(F.col(keys[0])) + sum((F.col(k) for k in keys[1:]), F.lit(0)) * 7, F.lit(1000))
    ranged = df.withColumn("_one", F.lit(1)).withColumn("_range", spread.cast("double"))
    dealt = accumulate(ranged, [label], [F.col(k) for k in keys], ["_one"])
    return dealt.withColumn("fold", ((F.col("_one_upto") - 1) % folds).cast("int")).drop(
        "_one", "_one_upto", "_one_total"
    )


