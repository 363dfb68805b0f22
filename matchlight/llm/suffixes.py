"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus.

1. Texts that are equal are one text with a count.
2. Every string of ``LENGTH`` bytes has an anchor: the leftmost of its ``GRAM``-byte substrings with the
   least hash. Equal strings have equal anchors at the same place. An anchor whose substring occurs
   once in all texts cannot belong to a repeated string; the others go on.
3. An anchor goes to the shard of its substring with its context, the bytes of the strings
   that have this anchor. A shard sorts all suffixes of its contexts (Larsson-Sadakane
   refinement: only unsorted groups are refined), takes common prefixes of neighbours by Kasai's rule and
   marks the strings whose prefix reaches ``LENGTH``.
4. A substring with more than ``SHARD_ROWS`` anchors is dealt to several shards. Strings that have no
   match in their own shard, and one of each class that has, are merged across those shards: sorted
   by hash, looked up by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlight.llm.text import prepare, whole_groups

LENGTH = 200
GRAM = 32
SHARD_ROWS = 4096
SHARD_BYTES = 1 << 17  # the working arrays of a shard fit a processor cache

# Odd multipliers of the rolling hash and its finish (fixed values).
LEVELS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
FINISH = 0xFF51AFD7ED558CCD
PLACE_BITS = 28


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every place on, by doubling."""
    h, step = data.astype(np.uint64) + np.uint64(1), 1
    for factor in LEVELS:
        h = h[:-step] * np.uint64(factor) + h[step:] if len(h) > step else h[:0]
        step *= 2
    h = (h ^ (h >> np.uint64(33))) * np.uint64(FINISH)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last): for every anchor the strings, by first byte, that have it."""
    if len(data) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    hashes = gram_hashes(data)
    width = length - GRAM + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    # Least of every window: the rest of one block and the start of the next.
    blocks = -(-len(ranked) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(ranked)] = ranked
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(ranked) - width + 1
    place = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:] - 1, windows - 1]
    return hashes[place[first]].view(np.int64), first, last


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in the order of at least their first ``depth`` bytes; the end comes before any byte.

    Texts one after the other need no mark between them: a string of ``depth`` bytes within a text is
    in order, and suffixes that share one are neighbours.
    """
    n = len(data)
    # Seven bytes of nine bits each (0: past the end) make the first keys.
    one = np.zeros(n + 8, dtype=np.int64)
    one[:n] = data
    one[:n] += 1
    two = (one[:-1] << 9) | one[1:]
    four = (two[:-2] << 18) | two[2:]
    key = (four[:n] << 27) | (four[4 : n + 4] >> 9)
    order = np.argsort(key)
    key = key[order]
    starts = np.empty(n, dtype=bool)
    starts[:1] = True
    np.not_equal(key[1:], key[:-1], out=starts[1:])
    rank = np.zeros(n + 2 * depth, dtype=np.int64)  # from 1; 0 past the end
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(1, n + 1), 0))
    h = 7
    while h < depth:
        alone = starts.copy()
        alone[:-1] &= starts[1:]
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        group = order[places]
        key = rank[group] * (n + 1) + rank[group + h]
        new = np.argsort(key)
        group, key = group[new], key[new]
        order[places] = group
        first = np.ones(len(places), dtype=bool)
        np.not_equal(key[1:], key[:-1], out=first[1:])
        starts[places] = first
        rank[group] = np.maximum.accumulate(np.where(first, places + 1, 0))
        h *= 2
    return order


def neighbour_prefixes(data: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of every suffix in ``order`` with the one before it (0 for the first).

    ``left``: how many bytes the suffix at each place has before its text ends. ``order`` may hold some
    of the suffixes only. Kasai's rule: if the neighbours of two suffixes in a row are in a row, too, the
    second prefix is one byte shorter. So bytes are compared at the heads of such runs only.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    has = np.flatnonzero(before >= 0)
    if not len(has):
        return np.zeros(len(order), dtype=np.int64)
    other = before[has]
    goes_on = np.zeros(len(has), dtype=bool)
    goes_on[1:] = (
        (has[1:] == has[:-1] + 1)
        & (other[1:] == other[:-1] + 1)
        & (left[has[1:]] == left[has[:-1]] - 1)
        & (left[other[1:]] == left[other[:-1]] - 1)
        & (data[has[:-1]] == data[other[:-1]])
    )
    heads = np.flatnonzero(~goes_on)
    words = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, dtype=np.uint8)], 8)
    a, b = has[heads], other[heads]
    most = np.minimum(left[a], left[b])
    size = np.zeros(len(heads), dtype=np.int64)
    active = np.flatnonzero(most > 0)
    while len(active):
        equal = words[a[active] + size[active]] == words[b[active] + size[active]]
        same = np.where(equal.all(axis=1), 8, np.argmin(equal, axis=1))
        size[active] += same
        active = active[(same == 8) & (size[active] < most[active])]
    head = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(has))))
    of_head = np.zeros(len(has), dtype=np.int64)
    of_head[heads] = np.minimum(size, most)
    prefix = np.zeros(n, dtype=np.int64)
    prefix[has] = np.maximum(of_head[head] - (np.arange(len(has)) - head), 0)
    return prefix[order]


def repeated(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of ``length`` bytes that occur again in the contexts.

    Returns where each context starts in their concatenation, a flag for every place that a string
    starting there occurs again, and for every place the first place of its class (-1: no string).
    """
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    left = np.repeat(starts[1:], sizes) - np.arange(len(data))
    order = suffix_array(data, length)
    order = order[left[order] >= length]
    same = neighbour_prefixes(data, left, order) >= length
    flag = np.zeros(len(data), dtype=bool)
    flag[order[same]] = True
    flag[order[np.flatnonzero(same) - 1]] = True
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    group = np.full(len(data), -1, dtype=np.int64)
    group[order] = order[head]
    return starts[:-1], flag, group


def _runs(flags: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of true values."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


SHARD_SCHEMA = "route long, w1 long, w2 long, k1 long, k2 long, first long, last long"


def _shard(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """Repeated strings of one shard, as runs, and the strings to be merged with other shards."""
    # Equal contexts are one context; all its strings occur again.
    place: dict[bytes, int] = {}
    number = [place.setdefault(context, len(place)) for context in frame["context"]]
    several = np.zeros(len(place), dtype=bool)
    np.logical_or.at(several, number, frame["several"].to_numpy(dtype=bool))
    several |= np.bincount(number, minlength=len(place)) > 1
    contexts = list(place)
    starts, flag, group = repeated(contexts, length)
    k1, k2, first, last = (frame[c].to_numpy() for c in ("k1", "k2", "first", "last"))
    number = np.array(number)
    whole = np.flatnonzero(several[number])
    spans = [np.stack([k1[whole], k2[whole], first[whole], last[whole]], axis=1)]
    # All other contexts have one row. Runs end with their context, as no string starts in its last bytes.
    row_of = np.zeros(len(contexts), dtype=np.int64)
    row_of[number] = np.arange(len(number))
    runs = _runs(flag)
    which = np.searchsorted(starts, runs[:, 0], "right") - 1
    runs, which = runs[~several[which]], which[~several[which]]
    row, base = row_of[which], first[row_of[which]] - starts[which]
    spans.append(np.stack([k1[row], k2[row], base + runs[:, 0], base + runs[:, 1] - 1], axis=1))
    opened, seen = [], set()
    for i in np.flatnonzero(frame["parts"].to_numpy() > 1):
        context, at = contexts[number[i]], starts[number[i]]
        for offset in range(len(context) - length + 1):
            own = not (several[number[i]] or flag[at + offset])
            if own or group[at + offset] not in seen:
                seen.add(group[at + offset])
                value = xxhash.xxh3_128_intdigest(context[offset : offset + length])
                w1, w2 = (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)
                opened.append((w1, w2, k1[i], k2[i], first[i] + offset if own else -1))
    s = np.concatenate(spans)
    o = np.array(opened, dtype=np.int64).reshape(-1, 5)
    none = np.zeros(len(s), dtype=np.int64)
    return pd.DataFrame(
        {
            "route": np.r_[s[:, 0], o[:, 0]],
            "w1": np.r_[none, o[:, 0]],
            "w2": np.r_[none, o[:, 1]],
            "k1": np.r_[s[:, 0], o[:, 2]],
            "k2": np.r_[s[:, 1], o[:, 3]],
            "first": np.r_[s[:, 2], o[:, 4]],
            "last": np.r_[s[:, 3], np.where(o[:, 4] >= 0, -1, -2)],
        }
    )


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """Runs as they are, and the strings (last -1) that also occur in another shard."""
    known = frame[frame["last"] >= 0]
    string = frame[frame["last"] < 0].sort_values(["w1", "w2"])
    if not len(string):
        return known[["k1", "k2", "first", "last"]]
    value = np.empty(len(string), dtype=[("a", np.int64), ("b", np.int64)])
    value["a"], value["b"] = string["w1"], string["w2"]
    # The sorted strings of all shards, numbered by distinct value, searched for those looked for.
    number = np.cumsum(np.r_[0, (value[1:] != value[:-1]).astype(np.int64)])
    asked = (string["last"] == -1).to_numpy()
    many = np.searchsorted(number, number[asked], "right") - np.searchsorted(number, number[asked], "left") > 1
    found = string[asked][many]
    return pd.concat([known, found.assign(last=found["first"])])[["k1", "k2", "first", "last"]]


def _contexts(frames: Iterator[pd.DataFrame], length: int, shard_rows: int) -> Iterator[pd.DataFrame]:
    """The contexts of repeated anchors; one that occurred before in its batch is repeated as a whole."""
    for frame in frames:
        seen: dict[tuple[int, bytes], int] = {}
        rows = []
        for k1, k2, text, found in zip(frame["k1"], frame["k2"], frame["text"], frame["found"]):
            data = text.encode()
            for a in found:
                context = data[a["first"] : a["last"] + length]
                known = seen.get((a["key"], context))
                if known is None:
                    seen[a["key"], context] = len(rows)
                    parts = -(-a["n"] // shard_rows)
                    part = xxhash.xxh3_64_intdigest(context) % parts
                    rows.append([a["key"], part, parts, False, k1, k2, a["first"], a["last"], context])
                else:
                    rows[known][3] = True
                    rows.append([a["key"], 0, 0, True, k1, k2, a["first"], a["last"], None])
        if rows:
            yield pd.DataFrame(
                rows, columns=["key", "part", "parts", "several", "k1", "k2", "first", "last", "context"]
            )


def _shards(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    empty = np.int64(0)
    for frame in whole_groups(frames, ["key", "part"], lambda f: int(f["context"].str.len().sum()), SHARD_BYTES):
        bare = frame["context"].isna()
        done = frame[bare]
        if len(done):
            yield pd.DataFrame(
                {"route": done["k1"], "w1": empty, "w2": empty, "k1": done["k1"], "k2": done["k2"],
                 "first": done["first"], "last": done["last"]}
            )
        if len(done) < len(frame):
            yield _shard(frame[~bare], length)


def remove(text: str, count: int, found, length: int = LENGTH) -> tuple[bytes, int, int]:
    """(bytes kept, bytes removed, runs removed) of a text that occurs ``count`` times.

    ``found``: (first, last) of places where repeated strings start.
    """
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    gone = np.zeros(len(data) + 1, dtype=np.int64)
    if count > 1 and len(data) >= length:
        gone[0] = 1
    for a in found if found is not None else ():
        gone[a["first"]] += 1
        gone[min(a["last"] + length, len(data))] -= 1
    mask = np.cumsum(gone)[:-1] > 0
    return data[~mask].tobytes(), int(mask.sum()), len(_runs(mask))


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, shard_rows: int = SHARD_ROWS, text_col: str = "text"
) -> DataFrame:
    """(k1, k2, n_bytes, n_removed, n_spans, kept): one row per distinct text, by its two hashes.

    ``kept`` is the text's UTF-8 without its repeated strings. NULL counts as the empty text. A text
    of several rows is a repeat of itself: if it has ``length`` bytes, nothing is left of it.
    It is one plan: its two reads of the texts share one exchange.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = (
        docs.select(*text_keys(text_col), text.alias("text"))
        .groupBy("k1", "k2")
        .agg(F.first("text").alias("text"), F.count("*").alias("rows"))
    )

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [anchors(np.frombuffer(value.encode(), dtype=np.uint8), length) for value in frame["text"]]
            each = [len(key) for key, _, _ in found]
            if sum(each):
                key, first, last = (np.concatenate(part) for part in zip(*found))
                k1, k2 = (np.repeat(frame[c].to_numpy(), each) for c in ("k1", "k2"))
                yield pd.DataFrame({"key": key, "k1": k1, "k2": k2, "first": first, "last": last})

    # A window, not a group and a join: the anchors are made and shuffled once.
    anchor = texts.mapInPandas(find, "key long, k1 long, k2 long, first long, last long").withColumn(
        "n", F.count("*").over(Window.partitionBy("key"))
    )
    candidates = (
        anchor.where("n > 1")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("key", "first", "last", "n")).alias("found"))
    )
    context_schema = (
        "key long, part long, parts long, several boolean, k1 long, k2 long, first long, last long, context binary"
    )
    spans = (
        texts.join(candidates, ["k1", "k2"])
        .mapInPandas(lambda frames: _contexts(frames, length, shard_rows), context_schema)
        .repartition("key", "part")
        .sortWithinPartitions("key", "part")
        .mapInPandas(lambda frames: _shards(frames, length), SHARD_SCHEMA)
        .repartition("route")
        .sortWithinPartitions("route")
        .mapInPandas(
            lambda frames: (_merge(f) for f in whole_groups(frames, ["route"], len, 50_000)),
            "k1 long, k2 long, first long, last long",
        )
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("first", "last")).alias("found"))
    )

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [
                (len(value.encode()), *remove(value, rows, found, length))
                for value, rows, found in zip(frame["text"], frame["rows"], frame["found"])
            ]
            yield pd.DataFrame(
                {
                    "k1": frame["k1"],
                    "k2": frame["k2"],
                    "n_bytes": [o[0] for o in out],
                    "n_removed": [o[2] for o in out],
                    "n_spans": [o[3] for o in out],
                    "kept": [o[1] for o in out],
                }
            )

    return texts.join(spans, ["k1", "k2"], "left").mapInPandas(
        cut, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def text_keys(text_col: str = "text"):
    """Two hashes that stand for a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")
