"""Benchmark decontamination by spaced seeds.

A seed is a window of words of which a fixed mask reads some, so a substituted word outside
the mask does not hide a match. Masks read pairs of neighbouring words. Which masks an item gets depends on its length, so that
wherever the permitted substitutions fall, some seed of some mask avoids them all. Documents get the masks of
the lengths that occur in the benchmark. Seeds of documents meet seeds of benchmark items in an equi-join;
around every hit the item is laid over the document and words are compared one by one.
Everything is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlight.session import stored

# Where the pairs of a mask start, by the least number of words of an item. For every length from
# eight words on, each placement of the permitted substitutions leaves a seed (enumerated in a test).
MASKS = {
    8: ((0, 3),),
    10: ((0, 2), (0, 3)),
    12: ((0, 3),),
    18: ((0, 9, 11), (0, 7, 11), (0, 3, 8)),
}
WINDOW = 20  # words compared at a time
MATCHED = 0.8  # share of a window that has to be equal
SHORT = 8  # items of fewer words have to agree in all of them
BROADCAST_ROWS = 1_000_000  # more seeds of benchmark items than this are joined by a shuffle


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def masks_of(length: int) -> tuple[tuple[int, ...], ...]:
    """The masks of items of so many words. Short items have one that reads every word."""
    if length < SHORT:
        return (tuple(sorted({*range(0, length - 1, 2), length - 2})) if length > 1 else (),)
    return MASKS[max(least for least in MASKS if least <= length)]


def _span(mask: tuple[int, ...]) -> int:
    """Words from the first to the last a mask reads; the mask without pairs reads a single word."""
    return mask[-1] + 2 if mask else 1


def _seeds(words: str, masks: list[tuple[int, ...]]) -> Column:
    """All seeds of an array of hashed words, mask after mask; seed i of a mask starts at word i."""
    pairs = f"zip_with(slice({words}, 1, greatest(size({words}) - 1, 0)), slice({words}, 2, greatest(size({words}) - 1, 0)), (a, b) -> xxhash64(a, b))"
    parts = ["cast(array() as array<bigint>)"]
    for mask in masks:
        name = "-".join(map(str, mask))
        m = f"greatest(size({words}) - {_span(mask) - 1}, 0)"
        if len(mask) < 2:
            single = f"slice(p, 1, {m})" if mask else words
            parts.append(f"transform({single}, a -> xxhash64(a, '{name}'))")
            continue
        seeds = f"slice(p, 1, {m})"
        for start in mask[1:-1]:
            seeds = f"zip_with({seeds}, slice(p, {1 + start}, {m}), (a, b) -> xxhash64(a, b))"
        parts.append(f"zip_with({seeds}, slice(p, {1 + mask[-1]}, {m}), (a, b) -> xxhash64(a, b, '{name}'))")
    # transform over one element binds the pairs to a name
    return F.expr(f"transform(array({pairs}), p -> concat({', '.join(parts)}))[0]")


def _start(place: str, n_words: str, masks: list[tuple[int, ...]]) -> Column:
    """The word a seed starts at, from its place in the array of ``_seeds``."""
    counts = [f"greatest({n_words} - {_span(mask) - 1}, 0)" for mask in masks]
    start = F.expr(place)
    for number in reversed(range(len(masks))):
        before = " + ".join(["0", *counts[:number]])
        here = F.expr(f"{place} - ({before})")
        start = F.when(F.expr(f"{place} < {before} + {counts[number]}"), here).otherwise(start)
    return start


def _item_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(seed, item_id, item_at) of all items; ``lengths`` are those that occur, more than 18 as 18."""
    seeds = items.sparkSession.createDataFrame([], "seed long, item_id long, item_at int")
    seeds = seeds.withColumn("item_id", F.col("item_id").cast(items.schema["item_id"].dataType))
    for masks in sorted({masks_of(n) for n in lengths}):
        of = [n for n in lengths if masks_of(n) == masks]
        part = (
            items.where(F.least(F.size("words"), F.lit(max(MASKS))).isin(of))
            .select("item_id", F.size("words").alias("n"), F.posexplode(_seeds("words", list(masks))).alias("place", "seed"))
            .select("seed", "item_id", _start("place", "n", list(masks)).alias("item_at"))
        )
        seeds = seeds.union(part)
    return seeds.distinct()


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, matched, n_words, at): items found in documents, best place each.

    An item is found if, laid over the document at a seed hit, some ``WINDOW`` words in a row
    (all, if it has fewer) agree in at least ``MATCHED`` of them; ``matched`` is the largest share,
    ``at`` the word of the document where the item starts (negative if it starts before). Items of fewer than
    eight words are found where all their words stand in a row. NULL and empty texts have no words: such an item is
    never found. Equal rows of documents give one result row; a passage in several items gives a row for each.
    """
    items = stored(
        benchmark.where("text is not null")
        .select("item_id", hashed(F.col("text")).alias("words"))
        .distinct(),
        "items",
    )
    top = max(MASKS)
    lengths = [r.n for r in items.select(F.least(F.size("words"), F.lit(top)).alias("n")).where("n > 0").distinct().collect()]
    masks = sorted({mask for n in lengths for mask in masks_of(n)})
    seeds = stored(_item_seeds(items, lengths), "seeds")
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    keyed = with_key(docs)
    hits = (
        keyed.select("doc_id", "text_key", hashed(F.col("text")).alias("words"))
        .select("doc_id", "text_key", F.size("words").alias("n"), F.posexplode(_seeds("words", masks)).alias("place", "seed"))
        .join(seeds, "seed")
        .select("doc_id", "text_key", "item_id", (_start("place", "n", masks) - F.col("item_at")).alias("at"))
        .distinct()
    )
    hits = stored(hits, "hits")
    found = hits.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key")).distinct()
    texts = (
        keyed.join(found, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")), "left_semi")
        .select(F.col("doc_id").alias("d_id"), F.col("text_key").alias("d_key"), hashed(F.col("text")).alias("doc_words"))
        .dropDuplicates(["d_id", "d_key"])
    )
    laid = (
        hits.join(texts, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_key") == F.col("d_key")))
        .join(items, "item_id")
        .withColumn(
            "equal",
            F.expr(
                "transform(words, (w, i) -> if(at + i >= 0 and at + i < size(doc_words)"
                " and get(doc_words, cast(at + i as int)) = w, 1, 0))"
            ),
        )
        .withColumn("span", F.least(F.size("words"), F.lit(WINDOW)))
        .select(
            "doc_id",
            "text_key",
            "item_id",
            "at",
            F.size("words").alias("n_words"),
            F.expr(
                "array_max(transform(sequence(1, size(words) - span + 1),"
                " s -> aggregate(slice(equal, s, span), 0, (a, e) -> a + e))) / span"
            ).alias("matched"),
        )
        .where(F.col("matched") >= F.when(F.col("n_words") < SHORT, 1.0).otherwise(MATCHED))
    )
    best = F.max(F.struct("matched", (-F.col("at")).alias("back"), "n_words")).alias("best")
    return laid.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id",
        "text_key",
        "item_id",
        F.col("best.matched").alias("matched"),
        F.col("best.n_words").alias("n_words"),
        (-F.col("best.back")).cast("long").alias("at"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, with their own columns."""
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key")).distinct()
    name = "key_of_" + "_".join(docs.columns)
    keyed = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = keyed["doc_id"].eqNullSafe(bad["b_id"]) & (keyed[name] == bad["b_key"])
    return keyed.join(bad, same, "left_anti").select(*docs.columns)
