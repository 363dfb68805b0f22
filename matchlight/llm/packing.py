"""Length buckets with the least padding, and token-budget batches inside each bucket.

The histogram of piece lengths over the whole corpus goes to the driver; it has at most
``max_length`` + 1 rows, because longer documents are cut into pieces of ``max_length`` tokens. A
dynamic programme over it chooses the bucket boundaries. Batches are cut from chunks of a bucket
that hold a bounded number of rows, so a bucket with most of the corpus is still many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlight.llm.text import word_count

MAX_LENGTH = 4096
BUCKETS = 12
TOKEN_BUDGET = 65536
BATCHES_PER_CHUNK = 64


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` length ranges with the least total padding.

    A row of length n in a bucket that ends at b costs b - n. No lengths give no boundaries.
    """
    if not lengths:
        return []
    order = np.argsort(lengths)
    size = np.asarray(lengths, dtype=np.float64)[order]
    rows = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64)[order])])
    tokens = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64)[order] * size)])
    n = len(size)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        new[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        best = new
        cuts.append(cut)
    ends, at = [], n
    for cut in reversed(cuts):
        if at == 0:
            break
        ends.append(int(size[at - 1]))
        at = int(cut[at])
    return ends[::-1]


def pieces(docs: DataFrame, max_length: int = MAX_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, n_tokens): every document in pieces of at most ``max_length`` words.

    A NULL or empty text is one piece of 0 tokens. Repeated rows stay repeated.
    """
    counted = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("all_tokens"))
    whole = F.greatest(F.ceil(F.col("all_tokens") / max_length), F.lit(1)).cast("int")
    return counted.select(
        "doc_id", "all_tokens", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece")
    ).select(
        "doc_id",
        "piece",
        F.least(F.col("all_tokens") - F.col("piece") * max_length, F.lit(max_length)).cast("int").alias("n_tokens"),
    )


def pack(
    rows: DataFrame,
    buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """Add bucket, boundary, batch_id, slot and padding to rows of (doc_id, piece, n_tokens).

    Every row gets exactly one place. A batch holds rows of one bucket, at most
    ``token_budget`` tokens with padding (one row, if the boundary alone is over the budget).
    Rows are dealt to the chunks of a bucket by a hash of (doc_id, piece), so the result does not
    depend on partitioning; equal rows are interchangeable.
    """
    histogram = rows.groupBy("n_tokens").count().orderBy("n_tokens").limit(max_length + 1).collect()
    ends = best_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    if not ends:
        ends = [max_length]
    amounts = np.zeros(len(ends), dtype=np.int64)
    for length, amount in histogram:
        amounts[np.searchsorted(ends, length)] += amount
    fits = [max(1, token_budget // max(1, end)) for end in ends]
    chunks = [int(max(1, -(-n // (f * BATCHES_PER_CHUNK)))) for n, f in zip(amounts, fits)]

    def pick(values: list[int]):
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1)

    bucket = F.lit(len(ends) - 1)
    for i in reversed(range(len(ends) - 1)):
        bucket = F.when(F.col("n_tokens") <= ends[i], F.lit(i)).otherwise(bucket)
    placed = (
        rows.withColumn("bucket", bucket)
        .withColumn("boundary", pick(ends))
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), pick(chunks)).cast("int"))
        .withColumn("fit", pick(fits))
    )
    order = Window.partitionBy("bucket", "chunk").orderBy("doc_id", "piece", "n_tokens")
    number = F.row_number().over(order) - 1
    return placed.withColumn("number", number).select(
        "doc_id",
        "piece",
        "n_tokens",
        "bucket",
        "boundary",
        F.concat_ws("-", "bucket", "chunk", F.floor(F.col("number") / F.col("fit"))).alias("batch_id"),
        (F.col("number") % F.col("fit")).cast("int").alias("slot"),
        (F.col("boundary") - F.col("n_tokens")).alias("padding"),
    )
