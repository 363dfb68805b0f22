"""SimHash near-duplicates through Golay-code keys.

A fingerprint has one bit per majority over the hashes of its word shingles. To find fingerprints
that differ in a few bits, parts of it become keys: a part of 23 bits is a word near exactly one
codeword of the binary Golay code, and the codewords nearest to the part and to its 23 neighbours
(one bit flipped) are its fuzzy keys, so parts that differ in one bit, or in two, share a key. A
key joins such a codeword with some bits that must be equal.

For 64 bits and at most 3 differing bits the keys miss nothing: of four 16-bit quarters at least
one has no error; of the two halves of the other 48 bits at least one has at most one. For longer
fingerprints and larger distances the keys are drawn at random (seeded) and the recall is
a matter of how many there are. ``keep_one`` takes its candidates from the former; pairs at the limit of
similarity, whose fingerprints differ in more bits, come from MinHash keys beside them.

Fingerprints that share a key are compared. What leaves a group is a spanning forest of its links,
never all its pairs; groups over ``GROUP_ROWS`` are cut into blocks and every pair of blocks is
a task of its own, so nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlight.llm.components import components
from matchlight.llm.text import byte_words, prepare, whole_groups, with_fields
from matchlight.operators import bloom
from matchlight.session import stored

GROUP_ROWS = 8192
SMALL_RUN = 48
FRAME_ROWS = 100_000
SHINGLES_AT_ONCE = 1 << 16

# Generator polynomial of the binary Golay code of length 23, and hash constants.
GOLAY = 0xAE3
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@lru_cache(maxsize=1)
def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of every 12-bit head shifted by 11, and the error of every remainder."""
    head = np.zeros(1 << 12, dtype=np.int32)
    for value in range(1 << 12):
        rest = value << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GOLAY << (bit - 11)
        head[value] = rest
    flips = [1 << i for i in range(23)]
    error = np.zeros(1 << 11, dtype=np.int32)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                wrong = flips[i] | flips[j] | flips[k]
                error[head[wrong >> 11] ^ (wrong & 0x7FF)] = wrong
    return head, error


def golay_index(word: np.ndarray) -> np.ndarray:
    """The message (12 bits) of the codeword nearest to each 23-bit word."""
    head, error = _golay_tables()
    return (word ^ error[head[word >> 11] ^ (word & 0x7FF)]) >> 11


def fuzzy_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct codewords nearest to each word and its one-bit neighbours."""
    masks = np.array([0, *(1 << i for i in range(23))], dtype=np.int32)
    codes = np.sort(golay_index(word.astype(np.int32)[:, None] ^ masks[None, :]), axis=1)
    first = np.ones(codes.shape, dtype=bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    return np.nonzero(first)[0], codes[first]


def _lanes(hashes: np.ndarray, lanes: int) -> list[np.ndarray]:
    """``lanes`` hashes per shingle; the first is the hash itself."""
    out = [hashes]
    with np.errstate(over="ignore"):
        for lane in range(1, lanes):
            x = hashes + np.uint64(lane * MIX[0] % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
            x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
            out.append(x ^ (x >> np.uint64(31)))
    return out


def _majority(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """How many hashes have each bit of each lane."""
    votes = np.zeros(64 * lanes, dtype=np.int64)
    for start in range(0, len(hashes), SHINGLES_AT_ONCE):
        for lane, values in enumerate(_lanes(hashes[start : start + SHINGLES_AT_ONCE], lanes)):
            bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes[64 * lane : 64 * lane + 64] += bits.sum(axis=0, dtype=np.int64)
    return votes


def of_set(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The fingerprint of a set of shingle hashes, as ``fingerprint`` gives it for texts without repeats."""
    return np.packbits(_majority(hashes, lanes) * 2 > len(hashes)).view(">u8").astype(np.uint64)


def fingerprint(words: list[bytes], shingle: int, lanes: int = 1) -> np.ndarray:
    """``lanes`` 64-bit words of the fingerprint; no words give zero."""
    if not words:
        return np.zeros(lanes, dtype=np.uint64)
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(64 * lanes, dtype=np.int64)
    for start in range(0, n, SHINGLES_AT_ONCE):
        hashes = np.fromiter(
            (
                xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42)
                for i in range(start, min(n, start + SHINGLES_AT_ONCE))
            ),
            dtype=np.uint64,
        )
        for lane, values in enumerate(_lanes(hashes, lanes)):
            bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes[64 * lane : 64 * lane + 64] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > n).view(">u8").astype(np.uint64)


def fingerprints(
    docs: DataFrame, shingle: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, f0, f1, ...): one row per input row, each 64 bits as a signed long.

    NULL and empty texts have fingerprint zero; fewer words than a shingle are one shingle.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = [f"f{i}" for i in range(lanes)]

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            yield _frame([fingerprint(byte_words(t), shingle, lanes) for t in texts], names)

    return with_fields(source, F.col("text"), run, ", ".join(f"{n} long" for n in names)).drop("text")


def _frame(values: list[np.ndarray], names: list[str]) -> pd.DataFrame:
    lanes = np.array(values, dtype=np.uint64).reshape(-1, len(names))
    return pd.DataFrame({name: lanes[:, i].copy().view(np.int64) for i, name in enumerate(names)})


def exact_plan() -> list[tuple[list[int], list[int]]]:
    """(bits that must be equal, 23 fuzzy bits) of the keys that find every pair within 3 of 64 bits."""
    plan = []
    for quarter in range(4):
        same = list(range(16 * quarter, 16 * quarter + 16))
        rest = [b for b in range(64) if b not in same]
        # The 24th bit of a half takes no part: it can only add errors.
        plan += [(same, rest[:23]), (same, rest[24:47])]
    return plan


def random_plan(bits: int, keys: int, equal: int, seed: int = 7) -> list[tuple[list[int], list[int]]]:
    """``keys`` random choices of ``equal`` bits that must be equal and 23 fuzzy bits."""
    draw = np.random.default_rng(seed)
    plan = []
    for _ in range(keys):
        chosen = draw.permutation(bits)[: equal + 23].tolist()
        plan.append((chosen[:equal], chosen[equal:]))
    return plan


def _cells(lanes: list[np.ndarray], plan) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for every key of every fingerprint."""
    words = np.stack(lanes, axis=1).astype(">u8")
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1)
    rows, cells = [], []
    for number, (same, fuzzy) in enumerate(plan):
        exact = bits[:, same].astype(np.int64) @ (1 << np.arange(len(same), dtype=np.int64))
        part = bits[:, fuzzy].astype(np.int32) @ (1 << np.arange(23, dtype=np.int32))
        row, code = fuzzy_keys(part)
        rows.append(row)
        cells.append((np.int64(number) << np.int64(len(same) + 12)) | (exact[row] << np.int64(12)) | code)
    return np.concatenate(rows), np.concatenate(cells)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _forest(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The links of a minimum spanning tree of one group that are not longer than ``most``."""
    rows = np.arange(1, len(values))
    nearest = np.zeros(len(rows), dtype=np.int64)
    length = _distance(values[1:], values[:1])
    links = []
    while len(rows):
        pick = int(np.argmin(length))
        at = rows[pick]
        if length[pick] <= most:
            links.append((nearest[pick], at))
        rows, nearest, length = (np.delete(x, pick) for x in (rows, nearest, length))
        if len(rows):
            new = _distance(values[rows], values[at][None, :])
            closer = new < length
            nearest[closer] = at
            length[closer] = new[closer]
    return links


def _spanning(u: np.ndarray, v: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of the links of a minimum spanning forest, shorter ones first (Kruskal)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    keep = []
    for i in np.lexsort((v, u, length)).tolist():
        a, b = root(int(u[i])), root(int(v[i]))
        if a != b:
            parent[a] = b
            keep.append(i)
    return np.array(keep, dtype=np.int64)


def _links(frame: pd.DataFrame, names: list[str], most: int) -> pd.DataFrame:
    """Links inside runs of equal keys of a sorted frame, as many as connect what is linked in it."""
    group = frame["group"].to_numpy()
    values = np.stack([frame[n].to_numpy().view(np.uint64) for n in names], axis=1)
    node = frame["node"].to_numpy()
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    in_small = np.repeat(sizes <= SMALL_RUN, sizes)
    for step in range(1, int(min(SMALL_RUN, sizes.max(initial=1)))):
        a = np.flatnonzero((group[:-step] == group[step:]) & in_small[:-step])
        a = a[_distance(values[a], values[a + step]) <= most]
        pairs.append(np.stack([a, a + step], axis=1))
    for start, size in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN]):
        pairs.append(np.array(_forest(values[start : start + size], most), dtype=np.int64).reshape(-1, 2) + start)
    at = np.concatenate(pairs)
    at = at[node[at[:, 0]] != node[at[:, 1]]]
    out = pd.DataFrame({"u": node[at].max(axis=1), "v": node[at].min(axis=1)}) if len(at) else pd.DataFrame({"u": [], "v": []}, dtype="int64")
    out["length"] = _distance(values[at[:, 0]], values[at[:, 1]])
    out = out.drop_duplicates(["u", "v"], ignore_index=True)
    return out.iloc[_spanning(out["u"].to_numpy(), out["v"].to_numpy(), out["length"].to_numpy())][["u", "v"]]


def _search(start: int, size: int, close) -> np.ndarray:
    """Links that connect all of a group that ``close`` pairs connect; who is reached is not asked again."""
    rest = np.arange(start, start + size)
    links = [np.zeros((0, 2), dtype=np.int64)]
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = np.full(len(rest), queue.pop())
            hit = close(at, rest)
            links.append(np.stack([at[hit], rest[hit]], axis=1))
            queue.extend(rest[hit].tolist())
            rest = rest[~hit]
    return np.concatenate(links)


def _close_links(frame: pd.DataFrame, close) -> pd.DataFrame:
    """Links of pairs that pass ``close``, inside runs of equal keys of a sorted frame, as many as connect all that pass.

    ``close`` takes two arrays of places. A pair is tested before anything is thinned out.
    """
    group, node = frame["group"].to_numpy(), frame["node"].to_numpy()
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    in_small = np.repeat(sizes <= SMALL_RUN, sizes)
    for step in range(1, int(min(SMALL_RUN, sizes.max(initial=1)))):
        a = np.flatnonzero((group[:-step] == group[step:]) & in_small[:-step])
        a = a[close(a, a + step)]
        pairs.append(np.stack([a, a + step], axis=1))
    pairs += [_search(start, size, close) for start, size in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN])]
    at = np.concatenate(pairs)
    at = at[node[at[:, 0]] != node[at[:, 1]]]
    out = pd.DataFrame({"u": node[at].max(axis=1), "v": node[at].min(axis=1)}, dtype="int64").drop_duplicates(ignore_index=True)
    return out.iloc[_spanning(out["u"].to_numpy(), out["v"].to_numpy(), np.zeros(len(out)))]


def link(fps: DataFrame, names: list[str], most: int, plan) -> DataFrame:
    """(u, v): links between distinct fingerprints of (node, *names), enough to connect all linked.

    ``fps`` has one row per fingerprint. Two fingerprints that share a key and differ in at most
    ``most`` bits are joined by a chain of links. A fingerprint of 64 bits may be its own node: ``names`` is
    ["node"] then, and nothing else travels with a key.
    """
    carried = [n for n in names if n != "node"]
    return _dealt(_spread(fps, names, carried, plan), lambda frame: _links(frame, names, most))


def _spread(fps: DataFrame, names: list[str], carried: list[str], plan) -> DataFrame:
    """(cell, node, *carried) for every key of every fingerprint."""

    def spread(frames):
        for frame in frames:
            if len(frame):
                row, cell = _cells([frame[n].to_numpy().view(np.uint64) for n in names], plan)
                out = frame.take(row)
                out.insert(0, "cell", cell)
                yield out

    columns = ", ".join(f"{n} long" for n in ("cell", "node", *carried))
    return fps.select("node", *carried).mapInPandas(spread, columns)


def _cell_sizes(cells: DataFrame) -> DataFrame:
    """(cell, count) of cells dealt by ``cell``. All columns are read, so that the shuffle of the rows serves the count, too."""
    return cells.groupBy("cell").agg(F.count(F.coalesce(*reversed(cells.columns))).alias("count"))


def _dealt(cells: DataFrame, links) -> DataFrame:
    """(u, v): what ``links`` finds in the cells; every pair of rows of a cell meets in a group."""
    carried = cells.columns[1:]

    def compare(frames):
        for frame in whole_groups(frames, ["group"], len, FRAME_ROWS):
            yield links(frame)

    # No cell is NULL. Said here, all three readers have the same rows, which are shuffled once.
    cells = cells.where("cell is not null").repartition("cell")
    hot = _cell_sizes(cells).where(F.col("count") > GROUP_ROWS)
    one = (
        cells.join(hot, "cell", "left")  # an anti join would go below the shuffle, which then serves it alone
        .where("count is null")
        .select(F.col("cell").alias("group"), *carried)
        .sortWithinPartitions("group")
        .mapInPandas(compare, "u long, v long")
    )
    # Large groups: every pair of blocks is a group.
    blocks = F.ceil(F.col("count") / GROUP_ROWS).cast("int")
    own = F.pmod(F.hash("node"), blocks)
    many = (
        cells.join(hot, "cell")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("group"), *carried)
        .repartition("group")
        .sortWithinPartitions("group")
        .mapInPandas(compare, "u long, v long")
    )
    return one.unionByName(many).distinct()


def near_duplicates(fps: DataFrame, lanes: int, most: int, plan) -> DataFrame:
    """Add ``component`` and ``component_id``, the smallest doc_id reachable, to (doc_id, f0, ...).

    Equal fingerprints are one node, so a group of copies costs one row. Rows with a NULL
    doc_id take part; a component of such rows alone has component NULL.
    """
    names = ["node"] if lanes == 1 else [f"f{i}" for i in range(lanes)]
    return _classes(fps, lanes, lambda nodes: link(nodes, names, most, plan))


def _classes(fps: DataFrame, lanes: int, links) -> DataFrame:
    """``near_duplicates`` by the links (u, v) that ``links`` gives for the nodes (node, f0, ...)."""
    names = [f"f{i}" for i in range(lanes)]
    node = F.col("f0") if lanes == 1 else F.xxhash64(*names)
    nodes = stored(
        fps.groupBy(*names).agg(F.min("doc_id").alias("least_id")).withColumn("node", node), "fingerprints"
    )
    label = components(links(nodes))
    labelled = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = stored(labelled.select("node", "component", "least_id"), "labelled")
    smallest = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_node = labelled.join(smallest, "component").select("node", "component", "component_id")
    return fps.withColumn("node", node).join(by_node, "node").drop("node")


def hex_text(name: str):
    return F.lpad(F.lower(F.hex(F.col(name))), 16, "0")


# Near-duplicate documents: Jaccard similarity of the sets of 5-word shingles.
SHINGLE = 5
SIMILAR = 0.8
LANES = 8  # fingerprints of 512 bits are a loose filter: what passes is compared exactly
LOOSE = 0.11  # three standard errors of the similarity that 512 bits estimate
CLOSE = 3  # differing bits of the first 64 at which the Golay keys miss no pair
BANDS, BAND = 16, 4  # keys of pairs beyond: a pair at similarity s shares one with probability 1 - (1 - s ** 4) ** 16
BLOCK_SHINGLES = 1 << 20
VERIFY_SHINGLES = 1 << 21  # of a frame compared at once


@lru_cache(maxsize=1)
def _band_constants() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7)
    salt = draw.integers(0, 1 << 64, BANDS * BAND, dtype=np.uint64)
    return salt[:, None], (draw.integers(0, 1 << 64, BANDS * BAND, dtype=np.uint64) | np.uint64(1))[:, None]


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the shingles of a text, sorted; fewer words than a shingle are one."""
    words = byte_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    hashes = (xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), 42) for i in range(n))
    return np.unique(np.fromiter(hashes, dtype=np.uint64, count=n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set: ``BAND`` least hashes each."""
    salt, odd = _band_constants()
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), 8192):
        mixed = (hashes[None, start : start + 8192] ^ salt) * odd
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * np.uint64(MIX[1])).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(MIX[0])
    for part in least.reshape(BANDS, BAND).T:
        key = (key ^ part) * np.uint64(MIX[2])
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def exact_links(node: np.ndarray, sets: list[np.ndarray], similar: float) -> np.ndarray:
    """Pairs of nodes that connect all that are connected by pairs of at least that similarity."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    pool, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = np.split(at, ends[:-1])
    mark = np.zeros(len(pool), dtype=bool)

    def close(a, b):
        # ``a`` is one place, repeated.
        pivot = own[a[0]]
        mark[pivot] = True
        common = np.zeros(len(b), dtype=np.int64)
        able = np.minimum(sizes[a], sizes[b]) >= similar * np.maximum(sizes[a], sizes[b]) - 1e-9
        for i in np.flatnonzero(able):
            common[i] = np.count_nonzero(mark[own[b[i]]])
        mark[pivot] = False
        return able & (common >= similar * (sizes[a] + sizes[b] - common) - 1e-9)

    return node[_search(0, len(sets), close)]


def _similarity(differing, bits: int, a, b):
    """Jaccard similarity from differing bits and shingle counts: the share of bits is an angle."""
    common = np.cos(differing / bits * np.pi) * np.sqrt(a * b)
    return common / (a + b - common)


def similar_documents(docs: DataFrame, similar: float = SIMILAR, slack: float = LOOSE) -> DataFrame:
    """(doc_id, text_key, shingles, component_id, f0, ...): near-duplicate classes of documents.

    Candidates are all pairs within ``CLOSE`` of the first 64 bits, found by their Golay keys, and pairs that share
    a MinHash key and have an estimated similarity of ``similar`` less ``slack`` from 512 bits (and less 1 / shingles,
    as the estimate is biased for short texts). They make loose classes; inside those the shingle sets are compared
    exactly. At similarity 0.8 a pair shares a MinHash key with probability 0.9998.
    """
    prepare(docs.sparkSession)
    names = [f"f{i}" for i in range(LANES)]
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    source = docs.select("doc_id", key.alias("text_key"), "text")

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            sets = [shingle_set(t) for t in texts]
            out = _frame([of_set(x, LANES) for x in sets], names)
            out.insert(0, "shingles", [len(x) for x in sets])
            out["cells"] = [bands(x) for x in sets]
            yield out

    columns = ", ".join(f"{n} long" for n in names)
    fields = f"shingles long, {columns}, cells array<long>"
    made = stored(with_fields(source, F.col("text"), run, fields).drop("text"), "documents")

    def likely(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.stack([frame[n].to_numpy().view(np.uint64) for n in names], axis=1)
        n = frame["shingles"].to_numpy()

        def close(a, b):
            least = similar - slack - 1 / np.maximum(1, np.minimum(n[a], n[b]))
            return _similarity(_distance(values[a], values[b]), 64 * LANES, n[a], n[b]) >= least

        return _close_links(frame, close)

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["group"], lambda f: int(f["hashes"].map(len).sum()) // 8, VERIFY_SHINGLES):
            for _, part in frame.groupby("group", sort=False):
                sets = [np.frombuffer(x, dtype=np.uint64) for x in part["hashes"]]
                found = exact_links(part["node"].to_numpy(), sets, similar)
                yield pd.DataFrame({"u": found[:, 0], "v": found[:, 1]}, dtype="int64")

    def hashes(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)

    def links(nodes: DataFrame) -> DataFrame:
        # A node's sets come from one of its rows.
        row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "shingles", "cells")
        one = stored(
            made.groupBy(*names).agg(F.min(row).alias("row")).select(F.xxhash64(*names).alias("node"), *names, "row.*"),
            "sets",
        ).where("shingles > 0")
        # Nodes with the same first 64 bits hang on the least of them, which stands for these bits.
        least = stored(one.groupBy(names[0]).agg(F.min("node").alias("least")), "first-bits")
        same_bits = one.select("node", names[0]).join(least, names[0]).select(F.col("node").alias("u"), F.col("least").alias("v"))
        # The table is small, the work on a row of it is not.
        first = least.select(F.col(names[0]).alias("node")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
        near = link(first, ["node"], CLOSE, exact_plan())
        for end in ("u", "v"):
            near = near.join(least.withColumnRenamed(names[0], end), end).drop(end).withColumnRenamed("least", end)
        near = near.select("u", "v").unionByName(same_bits.where("u <> v"))
        # Fingerprints travel only to keys that two nodes share.
        cells = one.select(F.explode("cells").alias("cell"), "node").where("cell is not null").repartition("cell")
        shared = cells.join(_cell_sizes(cells).where("count > 1"), "cell").drop("count")
        cells = shared.join(one.select("node", "shingles", *names), "node").select("cell", "node", "shingles", *names)
        loose = components(stored(near.unionByName(_dealt(cells, likely)), "candidate-links"))
        asked = stored(one.select("node", "doc_id", "text_key", "shingles").join(loose, "node"), "candidates")
        sizes = asked.groupBy("component").agg(F.ceil(F.sum("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
        wanted = asked.join(sizes, "component").select(
            "node", "component", "blocks", F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key")
        )
        same = source["doc_id"].eqNullSafe(wanted["k_id"]) & (source["text_key"] == wanted["k_key"])
        # Only texts that may be candidates are shuffled.
        texts = bloom.may_match(source, ["text_key"], asked, "text_key").join(wanted, same).select("node", "component", "blocks", "text")
        pairs = (
            texts.select("node", "component", "blocks", F.pandas_udf(hashes, "binary")("text").alias("hashes"))
            .withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "node", "hashes"
            )
            .repartition("group")
            .sortWithinPartitions("group")
        )
        return pairs.mapInPandas(verified, "u long, v long").where("u <> v")

    return _classes(made.drop("cells"), LANES, links)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id.

    Rows with a NULL doc_id stay only if their class has no id at all; of equal rows one stays.
    """
    found = stored(similar_documents(docs).select("doc_id", "text_key", "component"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    keep = (
        found.groupBy("component")
        .agg(first)
        .select(F.col("first.doc_id").alias("k_id"), F.col("first.text_key").alias("k_key"))
        .distinct()
    )
    # Rows that go, and repeated rows; texts of all others need no shuffle.
    own = F.xxhash64("doc_id", "text_key")
    kept_here = found["doc_id"].eqNullSafe(keep["k_id"]) & (found["text_key"] == keep["k_key"])
    gone = stored(found.join(keep, kept_here, "left_anti").select("doc_id", "text_key").distinct(), "gone")
    repeated = found.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
    repeats = repeated.limit(1).count() > 0
    asked = gone.unionByName(repeated) if repeats else gone
    name = "key_of_" + "_".join(docs.columns)
    keyed = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    row, in_doubt = f"row_{name}", f"doubt_{name}"
    keyed = bloom.marked(keyed.withColumn(row, F.xxhash64("doc_id", name)), [row], asked.select(own.alias("row")), "row", in_doubt)
    same = keyed["doc_id"].eqNullSafe(gone["doc_id"]) & (keyed[name] == gone["text_key"])
    doubtful = keyed.where(F.col(in_doubt)).join(gone, same, "left_anti")
    if repeats:
        doubtful = doubtful.dropDuplicates(["doc_id", name])
    return keyed.where(~F.col(in_doubt)).unionByName(doubtful).select(*docs.columns)
