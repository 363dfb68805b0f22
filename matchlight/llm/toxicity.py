"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (``SAMPLE_ROWS``) induces lexicons of words and of word beginnings
   whose presence in toxic rows is significant. They are dealt to several voters; patterns
   (shouting, runs of marks, insulting address, ...) are voters of their own.
2. A generative label model is fitted to the votes on all documents: one vote pattern and its count
   per row. Expectation maximisation estimates how each voter behaves on either class; voters
   correlated within the classes share their weight. The labelled sample only sets the start.
3. A linear classifier is fitted to the posteriors of the sample rows on features of the hits, and
   scores every text. Labels, language, source and ids are never features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlight.llm.text import prepare, remainder
from matchlight.session import stored

SAMPLE_ROWS = 60_000  # labelled rows that induce lexicons and fit the classifier, at most
LEXICON_SIZE = 4_000  # entries of all lexicons together, at most
SIGNIFICANT = 15.0  # log-likelihood ratio that makes a lexicon entry
PRECISE = 0.7  # share of toxic rows among those with a lexicon entry, or six times the usual share
THRESHOLD = 0.7
CACHE_WORDS = 500_000

WORD = re.compile(r"[^\W\d_]+")
ROWS, WHOLE = 0, 1  # kinds of entries besides word beginnings of 4 or 5 letters; ROWS counts documents
SPLITS = {WHOLE: 4, 5: 3, 4: 2}  # voters per kind of entry
PATTERNS = (
    re.compile(r"\b[A-Z]{4,}(?:\W+[A-Z]{4,}){4,}"),
    re.compile(r"[!?]{3,}"),
    re.compile(r"(?i)\b(?:you|he|she|they)(?:'re| are| is) (?:an? |all |such an? )?\w+"),
    re.compile(r"[@#$%&*]{4,}"),
)
VOTERS = sum(SPLITS.values()) + len(PATTERNS)
HITS = "array<double>"


def entries(word: str) -> list[tuple[int, int]]:
    """(kind, hash) of the lexicon entries a lower-case word can stand for."""
    out = [(WHOLE, word)] + [(n, word[:n]) for n in (5, 4) if len(word) >= n]
    return [(kind, xxhash.xxh3_64_intdigest(f"{kind}:{text}") >> 1) for kind, text in out]


def _voter(kind: int, entry: int) -> int:
    start = 0
    for name, parts in SPLITS.items():
        if name == kind:
            return start + entry % parts
        start += parts
    raise ValueError(kind)


def vote_features(text: str | None, lexicon: dict[int, int], cache: dict[str, tuple]) -> list[float]:
    """Hits of every voter, then the number of words. A NULL text is an empty one."""
    text = text or ""
    hits = [0.0] * (VOTERS + 1)
    total = 0
    for word, times in Counter(WORD.findall(text.lower())).items():
        total += times
        voters = cache.get(word)
        if voters is None:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            voters = cache[word] = tuple(lexicon[e] for _, e in entries(word) if e in lexicon)
        for voter in voters:
            hits[voter] += times
    first = VOTERS - len(PATTERNS)
    for i, pattern in enumerate(PATTERNS):
        hits[first + i] = float(len(pattern.findall(text)))
    hits[VOTERS] = float(total)
    return hits


@dataclass
class Model:
    """Lexicon (entry to voter) and the weights of the linear classifier."""

    lexicon: dict[int, int]
    weights: list[float]
    bias: float
    accuracies: np.ndarray  # P(vote | class), voters x (clean, toxic)
    correlations: np.ndarray  # within the classes, voters x voters


def labelled_sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic): at most ``rows`` labelled training rows, those with the least hashes.

    Rows whose crc32(doc_id) mod 3 is 1 are held out. A doc_id with several labels counts as toxic
    if one of them says so.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1))
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per entry and class in this task, and how many documents of each class."""
    seen: dict[tuple[int, int], list[int]] = {}

    def table() -> pd.DataFrame:
        keys = np.array(list(seen), dtype=np.int64).reshape(-1, 2)
        sides = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"kind": keys[:, 0], "entry": keys[:, 1], "clean": sides[:, 0], "toxic": sides[:, 1]})

    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"]):
            side = 1 if toxic == 1 else 0
            found = {(ROWS, 0)}
            for word in set(WORD.findall((text or "").lower())):
                found.update(entries(word))
            for key in found:
                seen.setdefault(key, [0, 0])[side] += 1
        if len(seen) > 400_000:
            yield table()
            seen.clear()
    yield table()


def induce_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> dict[int, int]:
    """entry -> voter for entries whose presence in toxic rows of (text, toxic) is significant."""
    counts = stored(
        rows.mapInPandas(_counted, "kind long, entry long, clean long, toxic long")
        .groupBy("kind", "entry")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "entries",
    )
    total = counts.where(F.col("kind") == ROWS).first()
    if not total or not total.toxic or not total.clean:
        return {}
    share = total.toxic / (total.toxic + total.clean)
    both = F.col("clean") + F.col("toxic")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (part(F.col("toxic"), both * share) + part(F.col("clean"), both * (1 - share)))
    best = (
        counts.where((F.col("kind") != ROWS) & (F.col("toxic") >= 2))
        .withColumn("ratio", ratio)
        .where((F.col("ratio") >= SIGNIFICANT) & (F.col("toxic") / both >= F.least(F.lit(PRECISE), F.lit(6 * share))))
        .orderBy(F.desc("ratio"), "entry")
        .limit(size)
        .collect()
    )
    return {r.entry: _voter(r.kind, r.entry) for r in best}


def with_votes(docs: DataFrame, lexicon: dict[int, int], name: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the hits of every voter as an array column ``name``."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON_SIZE entries

    def run(texts: pd.Series) -> pd.Series:
        cache = {}
        return pd.Series([vote_features(t, shared.value, cache) for t in texts])

    return docs.withColumn(name, F.pandas_udf(run, HITS)(F.coalesce(F.col(text_col), F.lit(""))))


def fit_label_model(
    votes: np.ndarray, counts: np.ndarray, start: np.ndarray, prior: float, known: np.ndarray, toxic: np.ndarray, rounds: int = 50
):
    """Posteriors of vote patterns, class-wise vote rates and correlations within classes.

    ``votes``: patterns x voters of 0/1, ``counts``: documents per pattern, ``start``: first guess of
    the posteriors, ``prior``: share of toxic rows in the sample. ``known`` and ``toxic``: sample rows per
    pattern and the toxic ones among them; their classes are not estimated, and together they
    weigh at least as much as all other rows.
    """
    voters = votes.shape[1]
    posterior = start.astype(float)
    rates = np.full((voters, 2), 0.5)
    correlations = np.zeros((voters, voters))
    open_ = counts - known
    anchor = max(1.0, open_.sum() / known.sum()) if known.sum() else 0.0
    total = open_.sum() + anchor * known.sum()
    for _ in range(rounds):
        mass = np.stack(
            [open_ * (1 - posterior) + anchor * (known - toxic), open_ * posterior + anchor * toxic], axis=1
        )
        rates = (votes.T @ mass + 0.1) / (mass.sum(axis=0) + 1.0)
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        # Voters that agree within a class beyond its rates count less: they say the same thing.
        covariance = np.zeros((voters, voters))
        for side in range(2):
            centred = votes - rates[:, side]
            covariance += (centred * mass[:, side : side + 1]).T @ centred
        covariance /= total
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
        correlations = covariance / np.outer(spread, spread)
        shared = np.clip(correlations, 0, None)
        np.fill_diagonal(shared, 0)
        weight = 1 / (1 + shared.sum(axis=1))
        yes = np.log(rates[:, 1] / rates[:, 0])
        no = np.log((1 - rates[:, 1]) / (1 - rates[:, 0]))
        logit = np.log(prior / (1 - prior)) + (votes * (yes * weight) + (1 - votes) * (no * weight)).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - posterior).max(initial=0) < 1e-6:
            posterior = new
            break
        posterior = new
    return posterior, rates, correlations


def inputs(hits: np.ndarray) -> np.ndarray:
    """Classifier inputs of hit rows: log hits per voter, hits per hundred words, and any hit."""
    votes, words = hits[:, :-1], np.maximum(hits[:, -1:], 1)
    lexical = votes[:, : sum(SPLITS.values())].sum(axis=1, keepdims=True)
    return np.hstack([np.log1p(votes), np.log1p(100 * lexical / words), lexical > 0])


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps."""
    full = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(full.shape[1])
    penalty = np.full(full.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (p - target) + penalty * w
        hessian = (full * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and (doc_id, hits) of every document (stored).

    Without usable labels of both classes there is no lexicon: every score is low.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # At most SAMPLE_ROWS rows of two numbers.
    sample = F.broadcast(stored(labelled_sample(labels), "labelled"))
    lexicon = induce_lexicon(texts.join(sample, "doc_id").select("text", "toxic"))
    hits = stored(with_votes(texts, lexicon, "hits").select("doc_id", "hits"), "votes")

    pattern = F.expr(f"transform(slice(hits, 1, {VOTERS}), h -> if(h > 0, '1', '0'))")
    grouped = (
        hits.join(sample, "doc_id", "left")
        .groupBy(F.array_join(pattern, "").alias("pattern"))
        .agg(F.count("*").alias("n"), F.count("toxic").alias("known"), F.sum("toxic").alias("toxic"))
        .collect()  # at most 2 ** VOTERS rows
    )
    if not lexicon or not grouped:
        return Model(lexicon, [0.0] * (VOTERS + 2), -4.0, np.zeros((VOTERS, 2)), np.zeros((VOTERS, VOTERS))), hits
    votes = np.array([[c == "1" for c in r.pattern] for r in grouped], dtype=float)
    counts = np.array([r.n for r in grouped], dtype=float)
    known = np.array([r.known for r in grouped], dtype=float)
    toxic = np.array([r.toxic or 0 for r in grouped], dtype=float)
    prior = float(np.clip(toxic.sum() / max(1, known.sum()), 0.01, 0.99))
    start = (toxic + prior) / (known + 1)
    posterior, rates, correlations = fit_label_model(votes, counts, start, prior, known, toxic)
    by_pattern = dict(zip((r.pattern for r in grouped), posterior))

    rows = hits.join(sample, "doc_id", "left_semi").select("hits", F.array_join(pattern, "").alias("pattern"))
    fitted = rows.limit(2 * SAMPLE_ROWS).toPandas()
    x = inputs(np.array(fitted["hits"].tolist(), dtype=float).reshape(-1, VOTERS + 1))
    weights, bias = fit_linear(x, np.array([by_pattern[p] for p in fitted["pattern"]]))
    return Model(lexicon, weights.tolist(), bias, rates, correlations), hits


def score(model: Model, hits: Column) -> Column:
    """The classifier on a column of hits, between 0 and 1."""
    lexical = F.aggregate(F.slice(hits, 1, sum(SPLITS.values())), F.lit(0.0), lambda a, h: a + h)
    terms = [F.log1p(hits[i]) * F.lit(model.weights[i]) for i in range(VOTERS)]
    terms.append(F.log1p(F.lit(100.0) * lexical / F.greatest(hits[VOTERS], F.lit(1.0))) * F.lit(model.weights[VOTERS]))
    terms.append(F.when(lexical > 0, F.lit(model.weights[VOTERS + 1])).otherwise(0.0))
    z = F.lit(model.bias)
    for term in terms:
        z = z + term
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per input row."""
    model, hits = fit(docs, labels)
    scored = hits.withColumn("score", score(model, F.col("hits")))
    return scored.select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with their own columns."""
    model, _ = fit(docs, labels)
    name = "hits_of_" + "_".join(docs.columns)  # no column of docs has this name
    voted = with_votes(docs, model.lexicon, name)
    return voted.where(score(model, F.col(name)) < THRESHOLD).select(*docs.columns)
