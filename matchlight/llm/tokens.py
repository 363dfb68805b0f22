"""Token counts under a unigram segmentation, with a trie of pre-tokens.

The best segmentation of a pre-token into vocabulary pieces is found by forward scores: the best score of
a prefix needs the best scores of shorter prefixes only. So a trie over the distinct pre-tokens of
a task holds one score per node, computed once for all pre-tokens that share the prefix, and the
number of pieces at the nodes where a pre-token ends. The pieces that end at a place are found from the shortest
to the longest; where no piece ends like that, no longer one does.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlight.llm.text import prepare, with_fields

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRIE_NODES = 500_000
UNKNOWN = -20.0  # score of a byte of a character that no piece covers
SPACE = "▁"


def load_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces of a sentencepiece model and their unigram scores.

    A model that is not a unigram one has no probabilities; its pieces are in order of rank, and a
    piece of rank r gets the score of Zipf's law, -log(r + 1) less a constant.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [
        i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    norm = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return {model.id_to_piece(i): -math.log(r + 1) - norm for r, i in enumerate(plain)}


class Trie:
    """Distinct pre-tokens with forward scores; at most about ``TRIE_NODES`` nodes, then it starts anew."""

    def __init__(self, vocabulary: dict[str, float], nodes: int = TRIE_NODES):
        # Every ending of a piece, with the piece's score if it is one itself.
        self.endings: dict[str, float | None] = {}
        for piece in vocabulary:
            for start in range(len(piece) - 1, 0, -1):
                self.endings.setdefault(piece[start:])
        self.endings.update(vocabulary)
        self.nodes = nodes
        self._clear()

    def _clear(self) -> None:
        self.node: dict[str, int] = {}  # of every prefix met
        self.parent = [0]
        self.score = [0.0]
        self.pieces = [0]
        self.unknown = [0]

    def count(self, token: str) -> tuple[int, int]:
        """(pieces, bytes outside the vocabulary) of the best segmentation.

        Of segmentations with equal scores the one with fewer pieces counts.
        """
        node = self.node.get(token)
        if node is None:
            if len(self.score) > self.nodes:
                self._clear()
            node = self._insert(token)
        return self.pieces[node], self.unknown[node]

    def _insert(self, token: str) -> int:
        nodes, endings, parent = self.node, self.endings.get, self.parent
        score, pieces, unknown = self.score, self.pieces, self.unknown
        known, node = len(token), 0
        while known and (node := nodes.get(token[:known], 0)) == 0:
            known -= 1
        for end in range(known + 1, len(token) + 1):
            width = len(token[end - 1].encode())
            best, most, outside = score[node] + UNKNOWN * width, pieces[node] + width, unknown[node] + width
            at = node  # the prefix before the piece
            for start in range(end - 1, -1, -1):
                gain = endings(token[start:end], False)
                if gain is False:
                    break
                if gain is not None:
                    total = score[at] + gain
                    if total > best or total == best and (pieces[at] + 1, unknown[at]) < (most, outside):
                        best, most, outside = total, pieces[at] + 1, unknown[at]
                at = parent[at]
            parent.append(node)
            node = nodes[token[:end]] = len(score)
            score.append(best)
            pieces.append(most)
            unknown.append(outside)
        return node


def token_counts(
    docs: DataFrame, vocabulary: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_unknown_bytes): one row per input row, whole texts.

    Pre-tokens are runs without white space, each with a space mark before it. NULL and empty texts
    have none. Nothing is shuffled: a task's trie serves all its documents.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(vocabulary or load_vocabulary())  # the size of the vocabulary
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for texts in series:
            rows = []
            for text in texts:
                total = tokens = outside = 0
                for word, times in Counter((text or "").split()).items():
                    pieces, unknown = trie.count(SPACE + word)
                    total += times
                    tokens += times * pieces
                    outside += times * unknown
                rows.append((total, tokens, outside))
            yield pd.DataFrame(rows, columns=["n_pretokens", "n_tokens", "n_unknown_bytes"])

    fields = "n_pretokens long, n_tokens long, n_unknown_bytes long"
    return with_fields(source, F.col("text"), run, fields).drop("text")
