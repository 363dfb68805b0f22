"""Chat trees, whitening and hard negatives against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlight.llm import chat, negatives, whitening

CHATS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
MARKS = "\\### Assistant: </turn> ok"


def told(rows):
    """What reading back has to give, from plain rows."""
    by_id = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by_id[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for conv, turns in by_id.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        chars = sum(len(chat.escape(r, chat.ROLE_MARK)) + len(chat.escape(x)) + 14 for _, r, x in turns)
        out.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(out, key=str)


def check_trees(trees):
    """Every node once, depth first, without gaps; positions and stretches are those of the ancestors."""
    rows = trees.nodes.collect()
    nodes = {r.node: r for r in rows}
    assert len(nodes) == len(rows)
    children = collections.defaultdict(list)
    for r in rows:
        assert r.end - r.start == len(r.tokens)
        children[r.parent].append(r)
        chain, at = [], r
        while at.parent:
            at = nodes[at.parent]
            chain.append(at)
        assert r.tree == (chain[-1].node if chain else r.node)
        assert r.position == sum(len(c.tokens) for c in chain)
        places = [p for s in r.attends for p in range(s.start, s.end)]
        assert places == sorted(set(places)) == sorted(p for c in chain for p in range(c.start, c.end))
    for root in children[None]:
        order, stack = [], [root]
        while stack:
            at = stack.pop()
            order.append(at)
            stack += sorted(children[at.node], key=lambda c: -c.start)
        assert order[0].start == 0 and all(a.end == b.start for a, b in zip(order, order[1:]))
    return nodes


def test_escapes_are_reversible():
    draw = np.random.default_rng(1)
    parts = ["\\", "#", "##", "###", "</turn>", "</turn>\n", "### user: ", ":", "a", "\n", "é", " "]
    for _ in range(300):
        text = "".join(draw.choice(parts, draw.integers(0, 9)))
        role = "".join(draw.choice(parts, draw.integers(0, 4)))
        assert chat.unescape(chat.escape(text)) == text
        formatted = chat.OPEN + chat.escape(role, chat.ROLE_MARK) + chat.MIDDLE + chat.escape(text) + chat.CLOSE
        both = formatted + formatted
        first = chat.TURN.match(both)
        assert (chat.unescape(first[1]), chat.unescape(first[2]), first.end()) == (role, text, len(formatted))


def test_shared_turns_are_emitted_once(spark):
    draw = np.random.default_rng(2)
    rows = []
    for conv in range(120):
        path = [int(draw.integers(0, 2)) for _ in range(draw.integers(1, 7))]
        for turn, branch in enumerate(path):
            role = ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, f"turn {turn} says {branch} {MARKS if branch else ''}"))
    rows += [(1000, t, ("user", "assistant")[t % 2], f"word {t}") for t in range(300)]  # a long one
    rows += [(1001, t, ("user", "assistant")[t % 2], f"word {t}") for t in range(299)] + [(1001, 299, "user", "other")]
    trees = chat.format_chats(spark.createDataFrame(rows, CHATS).repartition(5))
    nodes = check_trees(trees)
    paths = {tuple(r[2:] for r in sorted(rows) if r[0] == c)[: k + 1] for c in {r[0] for r in rows} for k in range(400)}
    assert len(nodes) == len(paths)
    assert sorted(map(tuple, chat.read_back(trees).collect()), key=str) == told(rows)


def test_chats_with_odd_rows(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"),
        (None, 0, "user", "a"), (None, None, None, None), (None, 3, "assistant", None),
        (2, None, "assistant", ""), (3, 0, "assistant", "x" * 200_000), (3, 1, "assistant", " " * 50_000 + "é\U0001F600\r\n\t"),
        (4, 0, "a:b\n\\", "</turn>\n### user: x</turn>"), (5, 0, "", ""), (6, 0, "user", "a"), (7, 0, "user", "a"),
        (-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS),
    ]
    chats = spark.createDataFrame(rows, CHATS)
    for name in ("conv", "node", "path", "tree", "rank", "start", "place", "cell"):
        chats = chats.withColumn(name, F.lit(1))
    trees = chat.format_chats(chats)
    check_trees(trees)
    assert sorted(map(tuple, chat.read_back(trees).collect()), key=str) == told(rows)
    assert chat.read_back(chat.format_chats(chats.limit(0))).collect() == []


def test_a_first_turn_of_most_conversations(spark, monkeypatch):
    rows = [(c, 0, "user", "hello") for c in range(400)] + [(c, 1, "assistant", f"answer {c % 50}") for c in range(400)]
    monkeypatch.setattr(chat, "HOT_ROWS", 50)
    trees = chat.format_chats(spark.createDataFrame(rows, CHATS))
    assert len(check_trees(trees)) == 51
    assert sorted(map(tuple, chat.read_back(trees).collect()), key=str) == told(rows)


# whitening


def whitened(spark, vectors, **options):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in enumerate(vectors)]
    return whitening.whiten(spark.createDataFrame(rows, VECTORS), **options)


@pytest.mark.parametrize("spread", [1.0, 1e-4])
def test_whitening_equals_the_eigenvectors(spark, spread):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((400, 12)) * np.logspace(0, np.log10(spread), 12) * 100 + 7
    x = (x @ np.linalg.qr(draw.standard_normal((12, 12)))[0]).astype(np.float32)
    got = whitened(spark, x, components=8).toPandas().sort_values(["vec_id", "component"])
    whole = np.floor(64 * x.astype(float)) + 1_000_000
    n, s = len(x), whole.sum(axis=0)
    c = whole - s / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    want = (c @ w / np.sqrt(e))[:, :8]
    mine = got.whitened.to_numpy().reshape(n, 8)
    assert np.abs(mine * np.sign((mine * want).sum(axis=0)) - want).max() < 1e-7
    assert np.abs(got.explained.to_numpy()[:8] / (e[:8] / e.sum()) - 1).max() < 1e-9
    assert got.identity_error.max() < 1e-9 and set(got.n) == {n}
    assert got.deviation.tolist()[::8] == ((n * whole - s) ** 2).sum(axis=1).astype(int).tolist()


def test_whitening_with_dependent_columns(spark):
    draw = np.random.default_rng(4)
    x = np.floor(draw.standard_normal((300, 4)) * 64) / 64
    x = np.hstack([x, x[:, :2], np.ones((300, 2))])  # rank 4
    got = whitened(spark, x).toPandas()
    assert set(got.component) == {1, 2, 3, 4} and got.identity_error.max() < 1e-7
    c = np.floor(64 * x) - np.floor(64 * x).mean(axis=0)
    e = np.sort(np.linalg.eigvalsh(c.T @ c / 300))[::-1]
    shares = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.abs(shares / (e[:4] / e.sum()) - 1).max() < 1e-9


def test_whitening_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 1.5], [0.5, -1.0], [0.5, -1.0]]
    rows = [(i, v, None) for i, v in enumerate(good)] + [(None, [3.0, 3.0], 1)]
    rows += [(10, None, 1), (11, [], 1), (12, [1.0, None], 1), (13, [nan, 1.0], 1), (14, [1.0, inf], 1), (15, [1.0], 1)]
    vectors = spark.createDataFrame(rows, VECTORS)
    for name in ("x", "vector", "whitened", "component", "n"):
        vectors = vectors.withColumn(name, F.lit(1))
    got = whitening.whiten(vectors).collect()
    assert collections.Counter(r.vec_id for r in got) == {i: 2 for i in (0, 1, 2, 3, None)}
    assert {r.n for r in got} == {5} and {r.component for r in got} == {1, 2}
    assert whitening.whiten(vectors.limit(0)).collect() == []
    assert whitened(spark, [[1.0, 2.0]] * 3).collect() == []


def test_deviations_beyond_a_long_are_null():
    centre = whitening.Centre(3, [0, 0])
    data = [np.array([2**53, 5], dtype="<i8").tobytes(), np.array([1, 2], dtype="<i8").tobytes()]
    assert centre.deviations(data) == [None, 45]
    assert whitening.Centre(1, [7, 9]).deviations([np.array([7, 9], dtype="<i8").tobytes()]) == [0]


# hard negatives


@pytest.mark.parametrize("size, dims", [(100, 64), (2**20, 200), (2**24, 3)])
def test_products_by_residues_are_exact(size, dims):
    draw = np.random.default_rng(5)
    a, b = (draw.integers(-size, size + 1, (9, dims)) for _ in range(2))
    a[0] = b[0] = size
    b[1] = -size
    want = a.astype(object) @ b.T.astype(object)
    moduli = negatives.primes(2 * size * size * dims + 1)
    got = negatives.scores(negatives.Residues(a, moduli), negatives.Residues(b, moduli))
    assert got.astype(object).tolist() == want.tolist()


def mined(rows, anchors, k=5):
    out = []
    for i, a, la in rows:
        if not anchors(i):
            continue
        scored = [(-int(a @ b), j, lb == la) for j, b, lb in rows if j != i]
        for s, p, _ in sorted(x for x in scored if x[2])[:k]:
            window = sorted((t, j) for t, j, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s)
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(window[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_negatives_equal_brute_force(spark, block_bytes):
    draw = np.random.default_rng(6)
    centres = draw.standard_normal((5, 16))
    x = (centres[draw.integers(0, 5, 700)] + 0.6 * draw.standard_normal((700, 16))).astype(np.float32)
    x[100:200] = x[100]  # ties
    labels = draw.integers(0, 4, 700)
    rows = [(int(i), [float(v) for v in x[i]], int(labels[i])) for i in range(700)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(6)
    got = negatives.mine(vectors, F.col("label"), F.col("vec_id") % 20 == 0, block_bytes=block_bytes)
    whole = [(i, np.floor(256 * x[i].astype(float)).astype(np.int64), int(labels[i])) for i in range(700)]
    want = mined(whole, lambda i: i % 20 == 0)
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == want


def test_negatives_with_odd_rows(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [0.9, 0.5], 2), (4, [0.9, 0.1], 2),
        (None, [1.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 0.0], 2), (8, [], 2), (9, [1.0, 0.0], None),
        (10, [1.0, 0.0, 0.0], 1), (11, [3e38, 0.0], 2), (20, [0.0, 1.0], 7),
    ]
    vectors = spark.createDataFrame(rows, VECTORS)
    for name in ("x", "q", "rank", "block", "score", "squared"):
        vectors = vectors.withColumn(name, F.lit(1))

    def run(df):
        return negatives.mine(df, F.col("label"), F.col("vec_id") % 10 == 0)

    got = sorted(map(tuple, run(vectors).collect()))
    assert got == [(0, 1, r, j, 65536, 230 * 256) for r, j in ((1, 2), (2, 3), (3, 4))]
    assert run(vectors.limit(0)).collect() == []
