"""Hard negatives by exact integer scores in single-precision matrix products.

Components are whole numbers. Modulo a prime below 1,024 they lie within 511 of zero, so products of
64 components at a time are exact in single precision. A score is known modulo several primes and comes
back, with its sign, by Chinese remaindering; the primes are as many as the largest possible score needs.

Anchors are worked off in blocks of bounded size, each broadcast and compared with every row in a
pass over the table. A task keeps, for each query, its best rows only; a window picks among tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlight.llm.text import prepare
from matchlight.llm.wholes import matrix, whole_numbers
from matchlight.session import stored

POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100  # a negative's score is from 80 % to 100 % of the positive's
SCALE = 256
PRIME_LIMIT = 1024
EXACT = 2**24  # single precision holds every whole number up to here
LONGEST = float(2**55)  # squared length of a vector at most; scores and their hundredfold then fit 64 bits
BLOCK_BYTES = 32 << 20  # anchors broadcast at a time
ROWS = 2048
AT_ONCE = 256  # anchors compared with a block of rows at a time
LEAST = np.iinfo(np.int64).min


def primes(product: int, limit: int = PRIME_LIMIT) -> list[int]:
    """The largest primes below ``limit``, as many as their product needs to exceed ``product``."""
    out, whole, p = [], 1, limit
    while whole <= product:
        p -= 1
        if p > 1 and all(p % q for q in range(2, int(p**0.5) + 1)):
            out.append(p)
            whole *= p
    return out


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Remainders from -(p - 1) / 2 to (p - 1) / 2, for odd p."""
    half = p // 2
    return np.remainder(x + half, p) - half


class Residues:
    """A matrix of whole numbers modulo each of some primes."""

    def __init__(self, x: np.ndarray, moduli: list[int]):
        self.moduli = moduli
        self.parts = [balanced(x, p).astype(np.float32) for p in moduli]

    def some(self, at) -> Residues:
        out = object.__new__(Residues)
        out.moduli, out.parts = self.moduli, [part[at] for part in self.parts]
        return out


def scores(a: Residues, b: Residues) -> np.ndarray:
    """All inner products of the rows of two matrices, exact while their size is below half the product of the primes."""
    total, weight, digits = None, 1, []
    for p, left, right in zip(a.moduli, a.parts, b.parts):
        wide = (EXACT - 1) // (p // 2) ** 2
        known = np.zeros((len(left), len(right)), dtype=np.int64)
        for k in range(0, left.shape[1], wide):
            known += balanced((left[:, k : k + wide] @ right[:, k : k + wide].T).astype(np.int64), p)
        # Mixed radix: the part of the score that earlier primes have not fixed, divided by their product.
        for digit, step in digits:
            known = balanced((known - digit) * pow(step, -1, p), p)
        digit = balanced(known, p)
        total = digit if total is None else total + np.int64(weight) * digit
        digits.append((digit, p))
        weight = _wrapped(weight * p)
    return total


def _wrapped(value: int) -> int:
    """A whole number as 64 bits with a sign: sums that end within 64 bits may pass beyond them."""
    return (value + 2**63) % 2**64 - 2**63


class Best:
    """The best rows of every query so far: higher scores first, of equal ones the smaller id."""

    def __init__(self, queries: int, most: int):
        self.most = most
        self.score = np.full((queries, most), LEAST)
        self.id = np.zeros((queries, most), dtype=np.int64)

    def offer(self, queries: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries (rows) with some ids (columns); ``LEAST`` marks pairs that do not count."""
        if not found.size:
            return
        floor = self.score[queries, -1]
        if found.shape[1] > self.most:
            floor = np.maximum(floor, np.partition(found, -self.most, axis=1)[:, -self.most])
        at, column = np.nonzero((found >= floor[:, None]) & (found > LEAST))
        if not len(at):
            return
        touched, place = np.unique(at, return_inverse=True)
        rows = queries[touched]
        held = self.score[rows] > LEAST
        who = np.concatenate([place, np.nonzero(held)[0]])
        score = np.concatenate([found[at, column], self.score[rows][held]])
        named = np.concatenate([ids[column], self.id[rows][held]])
        order = np.lexsort((named, -score, who))
        who, score, named = who[order], score[order], named[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < self.most
        new_score, new_id = np.full((len(rows), self.most), LEAST), np.zeros((len(rows), self.most), dtype=np.int64)
        new_score[who[keep], rank[keep]] = score[keep]
        new_id[who[keep], rank[keep]] = named[keep]
        self.score[rows], self.id[rows] = new_score, new_id

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, rank = np.nonzero(self.score > LEAST)
        return query, self.id[query, rank], self.score[query, rank]


def labelled_rows(vectors: DataFrame, label: Column, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, x): the rows that take part, one for each id.

    Rows with a NULL id, a NULL label, or a vector that is NULL or empty, has NULL or non-finite components or is longer
    than the square root of 2^55 take no part. Of rows with one id, the one with the least label and then vector counts.
    """
    source = vectors.select(F.col(id_col).alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"))
    x = whole_numbers(F.col("vector"), scale)
    made = source.where("vec_id is not null and label is not null").select("vec_id", "label", x.alias("x")).where("x is not null")
    return made.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.*")


def squared_length(rows: DataFrame) -> DataFrame:
    """Add ``squared``, and drop vectors over the bound."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for data in series:
            yield pd.Series([float((np.frombuffer(d, dtype="<i8").astype(np.float64) ** 2).sum()) for d in data], dtype=np.float64)

    return rows.withColumn("squared", F.pandas_udf(run, "double")("x")).where(F.col("squared") <= LONGEST)


def compare(rows: DataFrame, queries: pd.DataFrame, moduli: list[int], most: int) -> DataFrame:
    """(q, vec_id, score): every task's best rows for each query.

    ``queries`` has anchor_id, label and x of the anchor and, for negatives, the positive's score; it is bounded by the
    size of a block. A query with a positive's score asks for other labels within the score's window, one without for
    the same label. Vectors of different lengths have no score. Rows with the anchor's id never count.
    """
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = shared.value
        negatives = "positive_score" in asked
        best = Best(len(asked), most)
        sides = []  # anchors of one length: their queries, ids, labels and residues
        for _, part in asked.groupby(asked["x"].map(len), sort=True):
            ids, first, of = np.unique(part["anchor_id"].to_numpy(), return_index=True, return_inverse=True)
            residues = Residues(matrix(part["x"].iloc[first].tolist()), moduli)
            sides.append((len(part["x"].iloc[0]), part.index.to_numpy(), of, ids, part["label"].to_numpy()[first], residues))
        windows = None
        if negatives:
            positive = asked["positive_score"].to_numpy(dtype=np.int64)
            windows = -((-LOW * positive) // 100), (HIGH * positive) // 100

        def block(part: pd.DataFrame) -> None:
            for size, places, of, ids, labels, residues in sides:
                same = part[part["x"].map(len) == size]
                if not len(same):
                    continue
                theirs = Residues(matrix(same["x"].tolist()), moduli)
                names, marks = same["vec_id"].to_numpy(), same["label"].to_numpy()
                for start in range(0, len(ids), AT_ONCE):
                    here = slice(start, start + AT_ONCE)
                    found = scores(residues.some(here), theirs)
                    equal = labels[here, None] == marks[None, :]
                    if not negatives:
                        found[~equal | (ids[here, None] == names[None, :])] = LEAST
                        best.offer(places[here_of(of, here)], found, names)
                        continue
                    found[equal | (ids[here, None] == names[None, :])] = LEAST
                    # The queries of these anchors, one for each positive.
                    mine = np.flatnonzero((of >= start) & (of < start + AT_ONCE))
                    low, high = windows[0][places[mine]], windows[1][places[mine]]
                    wide = found[of[mine] - start]
                    wide[(wide < low[:, None]) | (wide > high[:, None])] = LEAST
                    best.offer(places[mine], wide, names)

        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= ROWS:
                block(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            block(pd.concat(held, ignore_index=True))
        q, ids, score = best.rows()
        yield pd.DataFrame({"q": q, "vec_id": ids, "score": score})

    return rows.select("vec_id", "label", "x").mapInPandas(run, "q long, vec_id long, score long")


def here_of(of: np.ndarray, here: slice) -> np.ndarray:
    """Places of the queries of some anchors, in the anchors' order, where every anchor has one."""
    at = np.argsort(of, kind="stable")
    return at[here]


def mine(
    vectors: DataFrame,
    label: Column,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: float = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` and ``anchor`` are expressions over ``vectors`` and over the id as ``vec_id``. Rows that take no part are named in
    :func:`labelled_rows`. Scores are exact; higher ones come first, of equal ones the smaller id. An anchor without another row
    of its label has no positive, and a positive without a row in its window has no negative: neither gives rows. A negative
    score of the positive leaves an empty window. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = stored(squared_length(labelled_rows(vectors, label, scale, id_col, vector_col)), "labelled-vectors")
    size = rows.agg(F.max("squared"), F.max(F.length("x")), F.count("*"), F.count_if(anchor)).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size[3]:
        return spark.createDataFrame([], result)
    moduli = primes(2 * int(size[0]) + 1)
    # An anchor comes with its positives' scores, and its numbers with each of them.
    share = max(1, -(-size[3] * (size[1] + 64) * positives // block_bytes))
    anchors = rows.where(anchor).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(share)).cast("int"))
    found = []
    for block in range(share):
        asked = anchors.where(F.col("block") == block).select(F.col("vec_id").alias("anchor_id"), "label", "x").toPandas()
        if len(asked):
            # Stored, so that the broadcasts of one block end before those of the next begin.
            found.append(stored(_of_block(rows, asked, moduli, positives, negatives), "negatives"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _picked(compared: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return compared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _of_block(rows: DataFrame, asked: pd.DataFrame, moduli: list[int], positives: int, negatives: int) -> DataFrame:
    # At most ``positives`` rows for each anchor of the block.
    near = _picked(compare(rows, asked, moduli, positives), positives).toPandas()
    queries = asked.iloc[near["q"].to_numpy(dtype=np.int64)].reset_index(drop=True)
    queries["positive_id"], queries["positive_score"] = near["vec_id"].to_numpy(dtype=np.int64), near["score"].to_numpy(dtype=np.int64)
    spark = rows.sparkSession
    named = queries[["anchor_id", "positive_id", "positive_score"]].reset_index(names="q")
    asked_for = spark.createDataFrame(named, "q long, anchor_id long, positive_id long, positive_score long")
    picked = _picked(compare(rows, queries, moduli, negatives), negatives)
    return picked.join(F.broadcast(asked_for), "q").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
