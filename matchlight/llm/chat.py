"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them: a turn with all turns before it is a node, known by
a chained 128-bit hash. Paths of hashes in byte order are the depth-first order of the trees, as a path
comes right before those it is a prefix of. So sorting distinct paths by range and adding up the tokens of
the nodes each is the first to bring gives every node its place in its tree's token sequence, once.
A node carries the position its first token has in its own conversation, and the stretches of the sequence
that its ancestors take: a token attends to these and to the tokens before it in its own node.

No tree is ever in one task: tables hold a row per node or per turn, and ranges of the order are of about equal size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlight.llm.text import prepare
from matchlight.operators.skew import skew_join
from matchlight.session import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that cuts text before this vocabulary is applied, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEARNT = "assistant"  # the role under the loss mask
HASH = 16  # bytes of a node
LONG_RUN = 1024  # encoding takes time with the square of a run without (or of) spaces: longer ones are cut
HOT_ROWS = 1_000_000  # a node or path met by more rows than this is split in joins
CELL = 256  # tokens of a cell of the sequence, for finding the nodes in a stretch

# The template. A backslash before a mark, a colon in a role or a backslash makes it plain text.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
MARK = re.compile(r"\\|###|</turn>")
ROLE_MARK = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str, marks: re.Pattern = MARK) -> str:
    return marks.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


class Encoder:
    """Byte-level token ids of a vocabulary file given as its ranks; any text comes back exactly."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.coder = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.long = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))
        self.marks = lru_cache(4096)(self._encode)

    def _encode(self, text: str) -> list[int]:
        return self.coder.encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        out, start = [], 0
        for run in self.long.finditer(text):
            out += self._encode(text[start : run.end()])
            start = run.end()
        return out + self._encode(text[start:]) if start < len(text) else out

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """The tokens of a formatted turn, and from where to where they are its text."""
        head = self.marks(OPEN + escape(role, ROLE_MARK) + MIDDLE)
        body = self.encode(escape(text))
        return head + body + self.marks(CLOSE), len(head), len(head) + len(body)

    def decode(self, tokens) -> str:
        return self.coder.decode_bytes(tokens.tolist()).decode()


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def chain(before: bytes, role: str, text: str) -> bytes:
    """The hash of a turn and all turns before it."""
    part = role.encode()
    return hashlib.blake2b(before + len(part).to_bytes(8, "little") + part + text.encode(), digest_size=HASH).digest()


@dataclass
class ChatTrees:
    """``nodes``: (tree, start, end, position, node, parent, role, loss_start, loss_end, attends, tokens), a row per node;
    start and end are places in the token sequence of the tree, loss_start and loss_end are places in ``tokens``
    (NULL outside the loss), ``attends`` lists the stretches of the ancestors.

    ``members``: (conv_id, path), a row per conversation. ``paths``: (path, tree, stretches), a row per distinct
    conversation, with all the stretches of the sequence that are its turns.
    """

    nodes: DataFrame
    members: DataFrame
    paths: DataFrame


def hashed_turns(chats: DataFrame, ranks: dict[bytes, int], learnt: str) -> DataFrame:
    """(conv, node, parent, role, position, tokens, loss_start, loss_end, path): a row per turn, ``path`` with the last only.

    The turns of a conversation stream through one task in order; only the hash of the turns so far
    and the path, 16 bytes a turn, are held.
    """
    shared = chats.sparkSession.sparkContext.broadcast(ranks)  # the size of the vocabulary
    fields = "conv string, node binary, parent binary, role string, position long, tokens array<int>, loss_start int, loss_end int, path binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, current, held = Encoder(shared.value), (), None
        before, position, path = b"", 0, []
        for frame in frames:
            out = []
            for conv, role, text in zip(frame["conv"], frame["role"], frame["text"]):
                if current != (conv,):
                    if held is not None:
                        out.append((*held, b"".join(path)))
                    current, held, before, position, path = (conv,), None, b"", 0, []
                if held is not None:
                    out.append((*held, None))
                node = chain(before, role, text)
                tokens, start, end = encoder.turn(role, text)
                loss = (start, end) if role == learnt else (None, None)
                held = (conv, node, before or None, role, position, np.array(tokens, dtype=np.int32), *loss)
                before, position = node, position + len(tokens)
                path.append(node)
            yield _turn_frame(out)
        if held is not None:
            yield _turn_frame([(*held, b"".join(path))])

    return (
        chats.repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .select("conv", "role", "text")
        .mapInPandas(run, fields)
    )


def _turn_frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["conv", "node", "parent", "role", "position", "tokens", "loss_start", "loss_end", "path"]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"position": "int64", "loss_start": "Int32", "loss_end": "Int32"})


def format_chats(
    chats: DataFrame,
    vocabulary: str = VOCABULARY,
    learnt: str = LEARNT,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> ChatTrees:
    """The trees of a table of turns.

    Turns of a conversation go by turn number, NULL first, equal numbers by role and text; repeated rows are repeated turns. A
    NULL role or text counts as empty. Rows with a NULL id are one conversation with that id. Equal
    conversations are one path with several members. An empty table gives empty tables.
    """
    spark = chats.sparkSession
    prepare(spark)
    of_id = dict(chats.dtypes)[id_col]
    turns = chats.select(
        F.col(id_col).cast("string").alias("conv"),
        F.col(turn_col).alias("turn"),
        *[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))],
    )
    keyed = stored(hashed_turns(turns, load_ranks(vocabulary), learnt), "turns")
    ends = keyed.where("path is not null")
    # The order of paths in bytes, as numbers that rise within and between ranges of about equal size.
    distinct = ends.groupBy(F.col("node").alias("path_end")).agg(F.first("path").alias("path"))
    ranked = stored(
        distinct.repartitionByRange("path").sortWithinPartitions("path").withColumn("rank", F.monotonically_increasing_id()),
        "paths",
    )
    along = ranked.select(
        "rank",
        F.substring("path", 1, HASH).alias("tree"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), (F.length("path") / HASH).cast("int") - 1),
                lambda i: F.substring(F.col("path"), i * HASH + 1, F.lit(HASH)),
            )
        ).alias("depth", "node"),
    )
    # Each node is brought by the first path through it.
    brought = along.groupBy("node").agg(F.min("rank").alias("rank"), F.first("depth").alias("depth"), F.first("tree").alias("tree"))
    content = keyed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("parent", "role", "position", "tokens", "loss_start", "loss_end")])
    placed = stored(_places(brought.join(content.withColumn("length", F.size("tokens")), "node")), "nodes")
    # Where the nodes of each path are: stretches by the path that brought them.
    spots = placed.select("node", F.col("rank").alias("by"), "start", "end")
    stretches = stored(
        skew_join(along.select("rank", "node"), spots, "node", "rank", rows_per_task=HOT_ROWS)
        .groupBy("rank", "by")
        .agg(F.min("start").alias("start"), F.max("end").alias("end")),
        "stretches",
    )
    stretch = F.struct("start", "end")
    of_path = stretches.groupBy("rank").agg(
        F.sort_array(F.collect_list(F.when(F.col("by") != F.col("rank"), stretch))).alias("before"),
        F.min(F.when(F.col("by") == F.col("rank"), F.col("start"))).alias("own_start"),
        F.sort_array(F.collect_list(stretch)).alias("stretches"),
    )
    own = F.when(F.col("start") > F.col("own_start"), F.array(F.struct(F.col("own_start").alias("start"), F.col("start").alias("end"))))
    nodes = stored(
        placed.join(of_path.drop("stretches"), "rank").select(
            F.hex("tree").alias("tree"),
            "start",
            "end",
            "position",
            F.hex("node").alias("node"),
            F.hex("parent").alias("parent"),
            "role",
            "loss_start",
            "loss_end",
            F.concat("before", F.coalesce(own, F.slice("before", 1, 0))).alias("attends"),
            "tokens",
        ),
        "chat-nodes",
    )
    paths = ranked.join(of_path, "rank").select(
        F.hex("path_end").alias("path"), F.hex(F.substring("path", 1, HASH)).alias("tree"), "stretches"
    )
    members = ends.select(F.col("conv").cast(of_id).alias("conv_id"), F.hex("node").alias("path"))
    return ChatTrees(nodes, members, paths)


def _places(brought: DataFrame) -> DataFrame:
    """Add start and end within the tree: running totals of token counts in the order of (rank, depth).

    The high bits of a rank are its range. Totals of ranges, one row each, are added up first.
    """
    ranged = stored(brought.withColumn("range", F.shiftright("rank", 33)), "brought")
    sums = ranged.groupBy("range").agg(F.sum("length").alias("tokens"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range").orderBy("rank", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = ranged.select("node", "range", "rank", "depth", "length").join(F.broadcast(offsets), "range")
    ends = upto.withColumn("end_all", F.col("offset") + F.sum("length").over(inside))
    starts = stored(ends.withColumn("start_all", F.col("end_all") - F.col("length")), "places")
    # A tree begins where its root does, the last root so far. Ranges that begin inside a tree take it over.
    roots = starts.where("depth = 0").groupBy("range").agg(F.max("start_all").alias("last_root"))
    taken = sums.select("range").join(roots, "range", "left").select("range", F.max("last_root").over(ahead).alias("taken"))
    root = F.max(F.when(F.col("depth") == 0, F.col("start_all"))).over(inside)
    tree_start = F.coalesce(root, F.col("taken"))
    local = starts.join(F.broadcast(taken), "range").select(
        "node", (F.col("start_all") - tree_start).alias("start"), (F.col("end_all") - tree_start).alias("end")
    )
    return ranged.drop("range", "length").join(local, "node")


def read_back(trees: ChatTrees, vocabulary: str = VOCABULARY) -> DataFrame:
    """What the output says of every conversation, found through the stretches of its path and decoded from tokens.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). The digest of turns is of role, line feed,
    text and line feed for every turn; that of the loss is of all text under the mask, unescaped.
    """
    spark = trees.nodes.sparkSession
    prepare(spark)
    key = F.xxhash64("tree", "cell")
    wanted = (
        trees.paths.select("path", "tree", F.inline("stretches"))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))))
        .select("path", F.col("tree").alias("of_tree"), F.col("start").alias("low"), F.col("end").alias("high"), key.alias("place"))
    )
    there = trees.nodes.withColumn("cell", F.floor(F.col("start") / CELL)).withColumn("place", key)
    there = there.select("place", "tree", "start", "tokens", "loss_start", "loss_end")
    inside = (F.col("tree") == F.col("of_tree")) & (F.col("start") >= F.col("low")) & (F.col("start") < F.col("high"))
    found = skew_join(wanted, there, "place", "path", rows_per_task=HOT_ROWS).where(inside)
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, reader = Encoder(shared.value), None
        for frame in frames:
            out = []
            for path, tokens, low, high in zip(frame["path"], frame["tokens"], frame["loss_start"], frame["loss_end"]):
                if reader is None or reader.path != path:
                    if reader is not None:
                        out.append(reader.row())
                    reader = Reader(path, encoder)
                reader.read(tokens, low, high)
            yield pd.DataFrame(out, columns=Reader.FIELDS)
        if reader is not None:
            yield pd.DataFrame([reader.row()], columns=Reader.FIELDS)

    digests = (
        found.select("path", "start", "tokens", "loss_start", "loss_end")
        .repartition("path")
        .sortWithinPartitions("path", "start")
        .mapInPandas(run, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )
    digests = stored(digests, "digests")
    return skew_join(trees.members, digests, "path", "conv_id", rows_per_task=HOT_ROWS).drop("path")


class Reader:
    """One conversation, read from its tokens node by node."""

    FIELDS = ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def __init__(self, path: str, encoder: Encoder):
        self.path, self.encoder = path, encoder
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest = ""  # formatted text that is no whole turn yet

    def read(self, tokens, low, high) -> None:
        text = self.encoder.decode(tokens)
        self.chars += len(text)
        self.rest += text
        end = 0
        while turn := TURN.match(self.rest, end):
            self.turns.update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
            self.n_turns += 1
            end = turn.end()
        self.rest = self.rest[end:]
        if low == low and low is not None:
            learnt = unescape(self.encoder.decode(tokens[int(low) : int(high)]))
            self.loss.update(learnt.encode())
            self.loss_chars += len(learnt)

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"path {self.path} does not end with a whole turn")
        return self.path, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
