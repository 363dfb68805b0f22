"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of neighbouring pairs are gathered from all training documents. Their
quantised logarithms go into Bloom filters: an n-gram of level q is inserted once with each of
1..q, and a reader probes 1, 2, ... until a probe fails. Beside the counts the filter holds, for each
first word, the sum of the (quantised) counts of its pairs, so that a probability is

    p(word | before) = (count(before, word) + smoothing * p(word)) / (sum of the pairs of before + smoothing)

and the probabilities after any word add up to one, up to the steps of that sum (within 2 %) and false positives: over a
vocabulary of V words some V / 2,000 pairs appear that were never seen.

Keys travel packed: a row holds all keys of a block of texts that belong to one segment. The number of segments
follows the length of the training texts, each segment is a filter sized by what it holds, and nothing that was
counted stays outside. Texts are read twice, whatever their number: keys of all texts go to their segments once, a segment
fills its filter with those of training texts, probes it with all of them, and sends a byte a key back to the block.

The base score is exact: the ``HEAD`` most frequent words are looked up in the task, all others by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlight.llm.text import byte_words, prepare, remainder
from matchlight.session import stored

BLOCK_BYTES = 40 << 20  # of the filter, for a reader who holds it in blocks
TEXT_BYTES = 9 << 20  # of texts whose keys travel together
ROW_GROUP = 16 << 20  # of text blocks in their files: what a task that writes or reads them holds, beside one block
SEGMENT_CHARS = 1 << 23  # training text per segment
CONTEXT_SHARE = 8  # segments of pairs per segment of first words
BITS_EACH = 14  # bits per insertion
BITS_AT_ONCE = 5  # bits set in one 64-bit cell, so that a probe reads one cell
HEAD = 200_000
BASE = 1.5  # a level of words and of first words is one factor of this
FINE = 10  # steps within a level of first words
SMOOTHING = 20.0
KNOWN_KEYS = 60_000
WORDS, PAIRS, CONTEXTS, STEPS = 0, 1, 2, 3  # steps live in the segments of the first words
ASKED = 4  # first words that a block asks for
MOST = 255

# Not words, as words hold no white space.
START = np.int64(xxhash.xxh3_64_intdigest(b"\n<start>") - (1 << 63))
END = np.int64(xxhash.xxh3_64_intdigest(b"\n<end>") - (1 << 63))
SALT = 0x632BE59BD9B4E019
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values of the hash
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The upper half knows the first word, the lower half the second."""
    return ((mix(first) & ~LOW) | (mix(second ^ np.int64(SALT)) & LOW)).view(np.int64)


def context_keys(pairs: np.ndarray) -> np.ndarray:
    return pairs >> np.int64(32)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mix(keys ^ np.int64(0x5851F42D4C957F2D)) % np.uint64(max(1, segments))).astype(np.int32)


class WordKeys(dict):
    """Keys of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_KEYS:
            self.clear()
        key = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return key


def _flat(texts, known: WordKeys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, key before) of every token of some texts: words, then the end."""
    keys, sizes = [np.zeros(0, dtype=np.int64)], []
    for text in texts:
        words = byte_words(text)
        keys.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        keys.append(np.array([END]))
        sizes.append(len(words) + 1)
    key = np.concatenate(keys)
    size = np.array(sizes, dtype=np.int64)
    before = np.empty_like(key)
    before[1:] = key[:-1]
    before[np.cumsum(np.r_[0, size[:-1]])[: len(size)]] = START
    return np.repeat(np.arange(len(size)), size), key, before


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(n, at)


def _dealt(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments of some keys, and the order that brings keys of a segment together."""
    segment = segment_of(keys, segments)
    return segment, np.argsort(segment.astype(np.uint16) if segments <= 1 << 16 else segment, kind="stable")


def _packed(kind: int, keys: np.ndarray, n: np.ndarray, segments: int) -> list[dict]:
    """A row per segment with its keys and numbers; those of first words have 32 bits."""
    width = np.int32 if kind in (CONTEXTS, ASKED) else np.int64
    segment, order = _dealt(keys, segments)
    segment, keys, n = segment[order], keys[order], n[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]), len(keys)] if len(keys) else np.zeros(1, int)
    return [
        {"kind": kind, "segment": int(segment[a]), "keys": keys[a:b].astype(width).tobytes(), "n": n[a:b].tobytes()}
        for a, b in zip(cuts[:-1], cuts[1:])
    ]


def _unpacked(frame: pd.DataFrame, number: type, width: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(frame["keys"]), dtype=width)
    return keys.astype(np.int64), np.frombuffer(b"".join(frame["n"]), dtype=number)


def _probed(kinds: tuple[int, ...], frame: pd.DataFrame, segment: int, segments: int, bits: bytes) -> list[dict]:
    """The levels of the keys of each row, in their order, by probing the filter of the segment."""
    if not len(frame):
        return []
    part, width = (CONTEXTS, np.int32) if STEPS in kinds else (kinds[0], np.int64)
    size = np.zeros(segments, dtype=np.uint64)
    size[segment] = len(bits) // 8
    block = Block(np.frombuffer(bits, np.uint64), {part: np.zeros(segments, dtype=np.uint64)}, {part: size})
    keys, at = np.unique(np.frombuffer(b"".join(frame["keys"]), dtype=width), return_inverse=True)
    keys = keys.astype(np.int64)
    cuts = np.cumsum([0, *(len(k) // np.dtype(width).itemsize for k in frame["keys"])])
    rows = []
    for kind in kinds:
        levels = block.levels(keys, kind)[at]
        rows += [
            {"kind": kind, "segment": segment, "block": int(b), "n": levels[i:j].tobytes()}
            for b, i, j in zip(frame["block"], cuts[:-1], cuts[1:])
        ]
    return rows


def level_of(n: np.ndarray, base: float) -> np.ndarray:
    return np.minimum(np.floor(np.log(n) / np.log(base) + 1e-9), MOST - 1).astype(np.int64)


def pair_levels(n: np.ndarray) -> np.ndarray:
    """Levels of pairs are factors of 2: pairs seen once have level 1, and no pair has 0."""
    return level_of(n, 2.0) + 1


def pair_value(level: np.ndarray) -> np.ndarray:
    """The count that a level of pairs stands for; 0 outside."""
    level = level.astype(np.float64)
    return np.where(level > 1, 1.25 * 2.0 ** (level - 1), level)


def context_value(level: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.where(level > 0, BASE ** (level.astype(np.float64) - 1 + (step + 0.5) / FINE), 0.0)


def _cells(keys: np.ndarray, kind: int, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which of 2**32 cells, its bits) for each key at a level.

    One cell, but two for the first level of pairs, which is asked for far more pairs than there are.
    """
    salt = (level * 4 + kind + 1) * SALT % (1 << 63)
    x = keys ^ np.int64(salt)
    for _ in range(2 if kind == PAIRS and level == 1 else 1):
        x = mix(x)
        cell, rest = x >> HALF, x & LOW
        mask = np.uint64(1) << (rest & np.uint64(63))
        for i in range(1, BITS_AT_ONCE):
            mask |= np.uint64(1) << (rest >> np.uint64(6 * i) & np.uint64(63))
        yield cell, mask
        x = ~x


def fill(entries: list[tuple[int, np.ndarray, np.ndarray]]) -> bytes:
    """A Bloom filter sized for (kind, keys, level): each key once with every number up to its level."""
    # The first level of a pair sets the bits of two cells.
    insertions = sum(level.sum() + (np.count_nonzero(level) if kind == PAIRS else 0) for kind, _, level in entries)
    cells = max(1, -(-int(insertions) * BITS_EACH // 64))
    bits = np.zeros(cells, dtype=np.uint64)
    for kind, keys, level in entries:
        step = 1
        inside = level >= 1
        keys, level = keys[inside], level[inside]
        while len(keys):
            for cell, mask in _cells(keys, kind, step):
                np.bitwise_or.at(bits, (cell * np.uint64(cells) >> HALF).astype(np.int64), mask)
            step += 1
            inside = level >= step
            keys, level = keys[inside], level[inside]
    return bits.tobytes()


@dataclass
class Block:
    """Some segments of the filter. Keys of other segments have level 0 here."""

    bits: np.ndarray  # cells of 64 bits
    start: dict[int, np.ndarray]  # kind -> first cell of each segment
    size: dict[int, np.ndarray]  # kind -> cells of each segment, 0 if it is not here

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        part = CONTEXTS if kind == STEPS else kind
        segment = segment_of(keys, len(self.size[part]))
        start, size = self.start[part][segment], self.size[part][segment]
        level = np.zeros(len(keys), dtype=np.uint8)
        active = np.flatnonzero(size)
        keys, start, size = keys[active], start[active], size[active]
        for step in range(1, MOST + 1):
            inside = np.ones(len(keys), dtype=bool)
            for cell, mask in _cells(keys, kind, step):
                inside &= self.bits[(start + (cell * size >> HALF)).astype(np.int64)] & mask == mask
            active, keys, start, size = active[inside], keys[inside], start[inside], size[inside]
            if not len(active):
                break
            level[active] = step
        return level

    def token_levels(self, key: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Levels of word, pair, first word and its step for every token: tokens x 4."""
        out = np.zeros((len(key), 4), dtype=np.uint8)
        at, words = pd.factorize(key)
        out[:, WORDS] = self.levels(words, WORDS)[at]
        at, pairs = pd.factorize(pair_keys(before, key))
        out[:, PAIRS] = self.levels(pairs, PAIRS)[at]
        inner, contexts = pd.factorize(context_keys(pairs))
        for kind in (CONTEXTS, STEPS):
            out[:, kind] = self.levels(contexts, kind)[inner][at]
        return out


@dataclass
class Model:
    """What training leaves: tables in the shared folder, and a few numbers."""

    words: DataFrame  # (key, n), exact
    segments: DataFrame  # (kind, segment, size, bits)
    counts: dict[int, int]  # kind -> number of segments
    n: int
    v: int
    means: np.ndarray = field(default_factory=lambda: np.zeros(MOST + 1))  # mean count of a level of words

    @property
    def norm(self) -> float:
        return self.n + 0.1 * (self.v + 1)

    def probability(self, levels: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
        """From the levels of tokens to their probabilities after the token before."""
        alone = (self.means[levels[:, WORDS]] + 0.1) / self.norm
        context = context_value(levels[:, CONTEXTS], levels[:, STEPS])
        pair = np.minimum(pair_value(levels[:, PAIRS]), context)  # a pair without its first word is a false positive
        return (pair + smoothing * alone) / (context + smoothing)

    def blocks(self, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
        """Segments in blocks; the driver holds one block at a time, and two numbers per segment."""
        sizes = self.segments.select("kind", "segment", "size").orderBy("kind", "segment").collect()
        groups, room = [[]], block_bytes
        for row in sizes:
            if row["size"] > room and groups[-1]:
                groups.append([])
                room = block_bytes
            groups[-1].append(row)
            room -= row["size"]
        for group in groups:
            start = {k: np.zeros(max(1, c), dtype=np.uint64) for k, c in self.counts.items()}
            size = {k: np.zeros(max(1, c), dtype=np.uint64) for k, c in self.counts.items()}
            offset, place = 0, {}
            for row in group:
                start[row.kind][row.segment], size[row.kind][row.segment] = offset, row["size"] // 8
                place[row.kind, row.segment] = offset
                offset += row["size"] // 8
            bits = np.zeros(offset, dtype=np.uint64)
            if group:
                order = F.struct("kind", "segment")
                first, last = ((g.kind, g.segment) for g in (group[0], group[-1]))
                low, high = (F.struct(F.lit(k).alias("kind"), F.lit(s).alias("segment")) for k, s in (first, last))
                for row in self.segments.where(order.between(low, high)).select("kind", "segment", "bits").toLocalIterator():
                    at = place[row.kind, row.segment]
                    bits[at : at + len(row.bits) // 8] = np.frombuffer(row.bits, np.uint64)
            yield Block(bits, start, size)


REQUEST = "kind int, segment int, block long, keys binary, n binary"


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with some settings, and with its own again afterwards."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def text_blocks(docs: DataFrame, block_bytes: int = TEXT_BYTES) -> DataFrame:
    """Rows of (doc_id, held_out, text) gathered into rows of about ``block_bytes`` of text, stored.

    ``block`` plus the place in the lists is a number of its own for every row; it is fixed here, as the table is written once.
    """
    names = ("doc_id", "held_out", "text")
    fields = [T.StructField(c, T.ArrayType(docs.schema[c].dataType)) for c in names]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = TaskContext.get().partitionId() << 33, [], 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [table[c].chunk(0) for c in names]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *lists], names=["block", *names])

        for batch in batches:
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(names.index("text"))]
            start = 0
            for i, n in enumerate(sizes):
                size += n
                if size >= block_bytes:
                    held.append(batch.slice(start, i + 1 - start))
                    yield row()
                    first += sum(map(len, held))
                    start, held, size = i + 1, [], 0
            if start < len(sizes):
                held.append(batch.slice(start))
        if held:
            yield row()

    schema = T.StructType([T.StructField("block", T.LongType()), *fields])
    # The writer looks at its memory after every row; by default it would after a hundred, which is a whole file of blocks.
    settings = {f"parquet.{part}.size.row.check.{end}": "1" for part in ("block", "page") for end in ("min", "max")}
    with _settings(docs.sparkSession, settings | {"parquet.block.size": str(ROW_GROUP)}):
        return stored(docs.select(*names).mapInArrow(gather, schema), "texts")


def _requests(texts: DataFrame, segments: int, context_segments: int) -> DataFrame:
    """Keys of a block's texts (block, held_out, text), dealt to their segments, with counts in training rows.

    Counts of keys in held-out rows only are 0. First words are asked for in segments behind the others, so that they pass by these.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, words, pairs, trains, at = WordKeys(), [], [], [], None

        def table() -> pd.DataFrame:
            train = np.concatenate(trains)
            trains.clear()
            rows = []
            for kind, keys in ((WORDS, words), (PAIRS, pairs)):
                whole = np.concatenate(keys)
                keys.clear()
                key, n = _summed(whole, train)
                del whole
                rows += _packed(kind, key, n.astype(np.uint32), segments)
            first = np.unique(context_keys(key))
            asked = _packed(ASKED, first, np.zeros(len(first), dtype=np.uint8), context_segments)
            rows += [r | {"segment": r["segment"] + segments, "n": b""} for r in asked]
            return pd.DataFrame(rows).assign(block=at)[["kind", "segment", "block", "keys", "n"]]

        for frame in frames:
            for block, part in frame.groupby("block", sort=False):
                if at is not None and block != at:
                    yield table()
                at = block
                row, key, before = _flat(part["text"], known)
                words.append(key)
                pairs.append(pair_keys(before, key))
                trains.append((~part["held_out"].to_numpy(dtype=bool))[row].astype(np.int64))
        if at is not None:
            yield table()

    return texts.mapInPandas(count, REQUEST)


def _fitted(requests: DataFrame, segments: int, context_segments: int, asks: bool) -> tuple[DataFrame, DataFrame]:
    """What the segments make of their keys: (kind, segment, block, keys, n, bits), of words and pairs, and of first words.

    With ``asks`` the rows hold the levels of the keys of each block in ``n``, without the filter itself.
    """
    fields = REQUEST + ", bits binary"
    names = ["kind", "segment", "block", "keys", "n", "bits"]

    def table(rows: list[dict]) -> pd.DataFrame:
        empty = {"block": -1, "keys": b"", "n": b"", "bits": b""}
        return pd.DataFrame([empty | r for r in rows], columns=names)

    def merge(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        segment = int(group[0])
        if segment >= segments:
            return frame.assign(segment=segment - segments, bits=b"")[names] if asks else table([])
        rows = []
        for kind in (WORDS, PAIRS):
            own = frame[frame["kind"] == kind]
            keys, n = _unpacked(own, np.uint32)
            keys, n = _summed(keys, n.astype(np.int64))
            keys, n = keys[n > 0], n[n > 0]
            level = level_of(n, BASE) + 1 if kind == WORDS else pair_levels(n)
            bits = fill([(kind, keys, level)])
            if asks:
                rows += _probed((kind,), own, segment, segments, bits)
            if kind == WORDS:
                counted = {"keys": keys.tobytes(), "n": n.tobytes()}
                rows.append({"kind": WORDS, "segment": segment, "bits": b"" if asks else bits} | counted)
                continue
            if not asks:
                rows.append({"kind": PAIRS, "segment": segment, "bits": bits})
            first, mass = _summed(context_keys(keys), pair_value(level))
            rows += _packed(CONTEXTS, first, mass, context_segments)
        return table(rows)

    def contexts(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        segment = int(group[0])
        keys, mass = _summed(*_unpacked(frame[frame["kind"] == CONTEXTS], np.float64, np.int32))
        exact = np.log(mass) / np.log(BASE)
        level = np.floor(exact).astype(np.int64)
        step = np.minimum(((exact - level) * FINE).astype(np.int64), FINE - 1)
        bits = fill([(CONTEXTS, keys, level + 1), (STEPS, keys, step)])
        if not asks:
            return table([{"kind": CONTEXTS, "segment": segment, "bits": bits}])
        return table(_probed((CONTEXTS, STEPS), frame[frame["kind"] == ASKED], segment, context_segments, bits))

    # A segment is bounded: a key comes once per block of texts, and segments grow in number with the texts.
    merged = stored(requests.groupBy("segment").applyInPandas(merge, fields), "merged")
    inner = merged.where(F.col("kind").isin(CONTEXTS, ASKED))
    return merged.where(~F.col("kind").isin(CONTEXTS, ASKED)), inner.groupBy("segment").applyInPandas(contexts, fields)


def _segments(texts: DataFrame, segment_chars: int) -> tuple[int, int]:
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(32, int(chars) // segment_chars)
    return segments, max(4, segments // CONTEXT_SHARE)


def _model(merged: DataFrame, segments: DataFrame | None, counts: dict[int, int]) -> Model:
    """The model of merged rows: exact counts of words, and the mean count of each level."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            key, n = _unpacked(frame, np.int64)
            yield pd.DataFrame({"key": key, "n": n})

    counted = merged.where((F.col("kind") == WORDS) & (F.col("block") < 0)).select("keys", "n")
    words = stored(counted.mapInPandas(rows, "key long, n long"), "words")
    by_level = (
        words.groupBy(F.least(F.floor(F.log("n") / F.log(F.lit(BASE)) + 1e-9) + 1, F.lit(MOST)).cast("int").alias("level"))
        .agg(F.sum("n").alias("mass"), F.count("*").alias("v"))
        .collect()  # at most as many rows as levels
    )
    model = Model(words, segments, counts, sum(r.mass for r in by_level), sum(r.v for r in by_level))
    # A false positive may find a level that no word has: it stands for a factor more than the highest.
    for row in sorted(by_level, key=lambda r: r.level):
        model.means[row.level] = row.mass / row.v
    for level in range(1, MOST + 1):
        if not model.means[level]:
            model.means[level] = model.means[level - 1] or BASE ** (level - 0.5)
    return model


def train(texts: DataFrame, segment_chars: int = SEGMENT_CHARS) -> Model:
    """Count words and pairs of all rows of (text) and build the filter, segment by segment."""
    prepare(texts.sparkSession)
    segments, context_segments = _segments(texts, segment_chars)
    rows = text_blocks(texts.select(F.lit(0).alias("doc_id"), F.lit(False).alias("held_out"), "text"))
    merged, first = _fitted(_requests(_rows(rows), segments, context_segments), segments, context_segments, asks=False)
    whole = merged.unionByName(first).select("kind", "segment", F.octet_length("bits").alias("size"), "bits")
    counts = {WORDS: segments, PAIRS: segments, CONTEXTS: context_segments}
    return _model(merged, stored(whole, "segments"), counts)


def _rows(blocks: DataFrame) -> DataFrame:
    """The texts of blocks as rows again: those of a block come from one row, so they stay together and in order."""
    return blocks.select("block", F.inline(F.arrays_zip("held_out", "text")))


def score_documents(
    docs: DataFrame, block_bytes: int = TEXT_BYTES, head_size: int = HEAD, smoothing: float = SMOOTHING
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per input row.

    Training rows are those whose crc32(doc_id) mod 10 is not 0. NULL and empty texts are one
    token, the end. ``base_score`` uses exact counts, ``score`` the filter. Without training rows N and
    V are 0: every token has the base probability 1, and the score is 0. Texts travel in blocks of about ``block_bytes``; a
    text is scored in one task, whatever its length.
    """
    spark = docs.sparkSession
    prepare(spark)
    # A shuffle's files go when its table is written, not when the driver next collects garbage; tables are packed tighter.
    # Blocks are read one by one and tables with packed keys in small batches: a batch of 4,096 rows would be a whole file.
    settings = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.parquet.enableNestedColumnVectorizedReader": "false",
        "spark.sql.parquet.columnarReaderBatchSize": "512",
    }
    with _settings(spark, settings):
        return _scored(docs, block_bytes, head_size, smoothing)


def _scored(docs: DataFrame, block_bytes: int, head_size: int, smoothing: float) -> DataFrame:
    spark = docs.sparkSession
    source = docs.select("doc_id", "text", (remainder("doc_id", 10) == 0).alias("held_out"))
    segments, context_segments = _segments(source.where("not held_out"), SEGMENT_CHARS)
    blocks = text_blocks(source, block_bytes)
    merged, first = _fitted(_requests(_rows(blocks), segments, context_segments), segments, context_segments, asks=True)
    counts = {WORDS: segments, PAIRS: segments, CONTEXTS: context_segments}
    model = _model(merged, None, counts)
    words, norm = model.words, model.norm
    bare = Model(None, None, counts, model.n, model.v, model.means)  # what tasks need
    top = words.orderBy(F.desc("n"), "key").limit(head_size).select("key", "n").toPandas().sort_values("key")
    head = spark.sparkContext.broadcast((top["key"].to_numpy(dtype=np.int64), top["n"].to_numpy(dtype=np.int64)))

    def looked_up(keys: np.ndarray, kinds: tuple[int, ...], answers: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
        """The levels of distinct keys by kind, and where each of ``keys`` is among the distinct ones."""
        distinct, at = np.unique(keys, return_inverse=True)
        _, order = _dealt(distinct, counts[CONTEXTS if STEPS in kinds else kinds[0]])
        found = []
        for kind in kinds:
            level = np.empty(len(distinct), dtype=np.uint8)
            own = answers[answers["kind"] == kind].sort_values("segment")
            level[order] = np.frombuffer(b"".join(own["n"]), dtype=np.uint8)
            found.append(level)
        return found, at

    def token_levels(key: np.ndarray, before: np.ndarray, answers: pd.DataFrame) -> np.ndarray:
        """Levels of word, pair, first word and its step for every token: tokens x 4."""
        out = np.zeros((len(key), 4), dtype=np.uint8)
        (level,), at = looked_up(key, (WORDS,), answers)
        out[:, WORDS] = level[at]
        pairs, at = np.unique(pair_keys(before, key), return_inverse=True)
        (level,), _ = looked_up(pairs, (PAIRS,), answers)
        out[:, PAIRS] = level[at]
        levels, inner = looked_up(context_keys(pairs), (CONTEXTS, STEPS), answers)
        for kind, level in zip((CONTEXTS, STEPS), levels):
            out[:, kind] = level[inner][at]
        return out

    def score(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        head_key, head_n = head.value
        made = []
        for block, text in zip(texts["block"], texts["text"]):  # one row
            row, key, before = _flat(text, WordKeys())
            rows = len(text)
            at, unique = pd.factorize(key)
            place = np.minimum(np.searchsorted(head_key, unique), max(len(head_key) - 1, 0))
            in_head = head_key[place] == unique if len(head_key) else np.zeros(len(unique), dtype=bool)
            exact = np.zeros(len(unique))
            if len(head_key):
                exact[in_head] = np.log10((head_n[place[in_head]] + 0.1) / norm)
            known = in_head[at]
            # The rest by document and word.
            rest_row, rest_key = row[~known], key[~known]
            order = np.lexsort((rest_key, rest_row))
            rest_row, rest_key = rest_row[order], rest_key[order]
            new = np.ones(len(rest_row), dtype=bool)
            new[1:] = (rest_row[1:] != rest_row[:-1]) | (rest_key[1:] != rest_key[:-1])
            starts = np.flatnonzero(new)
            times = np.diff(np.r_[starts, len(rest_row)])
            rest_row, rest_key = rest_row[starts], rest_key[starts]
            cut = np.searchsorted(rest_row, np.arange(rows + 1))
            # The model.
            points = np.zeros(len(key))
            if bare.n:
                points = np.log10(bare.probability(token_levels(key, before, answers), smoothing))
            made.append(
                pd.DataFrame(
                    {
                        "place": block + np.arange(rows),
                        "n_tokens": np.bincount(row, minlength=rows),
                        "head_known": np.bincount(row, weights=known, minlength=rows).astype(np.int64),
                        "head_score": np.bincount(row, weights=exact[at], minlength=rows),
                        "score": np.bincount(row, weights=points, minlength=rows),
                        "rest_keys": [rest_key[a:b] for a, b in zip(cut[:-1], cut[1:])],
                        "rest_n": [times[a:b] for a, b in zip(cut[:-1], cut[1:])],
                    }
                )
            )
        return pd.concat(made)

    fields = (
        "place long, n_tokens long, head_known long, head_score double, score double, rest_keys array<long>, rest_n array<long>"
    )
    answers = merged.where("block >= 0").unionByName(first).select("kind", "segment", "block", "n")
    both = blocks.select("block", "text").groupBy("block").cogroup(answers.groupBy("block"))
    scored = stored(both.applyInPandas(score, fields), "scored")
    rest = (
        scored.select("place", F.explode(F.arrays_zip("rest_keys", "rest_n")).alias("r"))
        .select("place", F.col("r.rest_keys").alias("key"), F.col("r.rest_n").alias("times"))
        .join(words.select("key", F.col("n").alias("c")), "key", "left")
        .groupBy("place")
        .agg(
            F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(norm))).alias("rest_score"),
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
        )
    )
    ids = blocks.select("block", F.posexplode(F.arrays_zip("doc_id", "held_out")).alias("pos", "d")).select(
        (F.col("block") + F.col("pos")).alias("place"), "d.doc_id", "d.held_out"
    )
    whole = ids.join(scored.drop("rest_keys", "rest_n"), "place").join(rest, "place", "left")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rest_score", F.lit(0.0))).alias("base_score"),
        "score",
    )
