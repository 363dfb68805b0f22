"""Corrections, deletions and repeats through the store, and the folders it opens for them."""

import json

import numpy as np
from conftest import AS_OF, rows
from pyspark.sql import functions as F
from test_events import event

from matchlight.operators import bloom, rollup
from matchlight.sources.idindex import IdIndex
from matchlight.streaming import ingest as I

STATS = ["player_id", "game_id", *rollup.COUNTS, "first_played", "last_played"]


def sent(spark, *messages):
    return spark.createDataFrame(list(messages), "routing_key string, body string")


def over(match_id, day, **changes):
    times = {"startTime": f"2024-06-{day:02}T10:00:00", "endTime": f"2024-06-{day:02}T10:30:00"}
    return "game.over", event(match_id, **{**times, **changes})


def corrected(match_id, day, at, **changes):
    return I.CORRECTED, over(match_id, day, **changes, changedAt=f"2024-06-28T{at:02}:00:00")[1]


def deleted(match_id):
    return I.DELETED, json.dumps({"matchId": str(match_id)})


def agree(store):
    """The statistics equal the roll-up of the matches as they are."""
    full = rollup.player_game_stats(store.matches(), store.moves())
    got, want = (rows(df.select(*STATS), "player_id", "game_id") for df in (store.stats(), full))
    assert got == want
    return got


def test_changes_reach_statistics_matches_and_moves(spark, small, tmp_path):
    store = I.EventStore(spark, str(tmp_path))
    batches = [
        [over(1, 1), over(2, 2, winnerId=None), over(3, 3), over(4, 3, player1Id="2", winnerId="2")],
        # the last match moves to another day and has another winner; a match that is not there
        [corrected(3, 1, 5, winnerId="1"), corrected(99, 1, 5), over(5, 4)],
        # older than the one above; the same again; then deletions, of a match of the same batch, too
        [corrected(3, 9, 4), corrected(1, 1, 6), deleted(5), over(6, 5), deleted(6), deleted(77)],
        [corrected(5, 5, 9), over(5, 4), corrected(2, 2, 7, player2MoveCounts=40)],
        [deleted(3), deleted(1), deleted(2)],
    ]
    left = [{1, 2, 3, 4}, {1, 2, 3, 4, 5}, {1, 2, 3, 4}, {1, 2, 3, 4}, {4}]
    for i, (batch, ids) in enumerate(zip(batches, left)):
        store.add_matches(sent(spark, *batch), i, small.game_names, small.players, AS_OF)
        assert {r.match_id for r in store.matches().collect()} == ids
        before = agree(store)
        if i == 2:  # once more
            store.add_matches(sent(spark, *batch), i, small.game_names, small.players, AS_OF)
            assert agree(store) == before
    at = {r.match_id: r for r in store._current(before=3).collect()}
    assert str(at[3].start_time)[:10] == "2024-06-01" and at[3].winner_id == 1
    assert {(r.match_id, r.moves_count) for r in store.moves().collect()} == {(4, 11), (4, 12)}
    reasons = sorted(r.reject_reason for r in store.rejected().collect())
    assert reasons == ["deleted_match", "unknown_match", "unknown_match"]
    store.compact(2)
    assert rows(store.stats().select(*STATS), "player_id", "game_id") == before


def test_days_that_lose_their_first_or_last_match(spark, small, tmp_path):
    draw = np.random.default_rng(1)
    store = I.EventStore(spark, str(tmp_path))
    ids = iter(range(10_000))

    def new(n):
        return [over(next(ids), int(draw.integers(1, 4)), startTime=f"2024-06-0{draw.integers(1, 4)}T{draw.integers(0, 9):02}:00:00",
                     endTime=f"2024-06-04T{draw.integers(10, 23)}:00:00", winnerId=str(draw.choice([1, 3]))) for _ in range(n)]

    for i in range(3):
        batch = new(12)
        for match_id in draw.choice(12 * (i + 1), 4, replace=False):
            hour, day = draw.integers(0, 9), draw.integers(1, 5)
            batch.append(deleted(match_id) if draw.random() < 0.4 else corrected(int(match_id), int(day), int(hour), winnerId="1"))
        store.add_matches(sent(spark, *batch), i, small.game_names, small.players, AS_OF)
        agree(store)
        if i == 1:
            store.compact(1)


def test_only_folders_that_may_hold_an_id_are_opened(spark, small, tmp_path):
    store = I.EventStore(spark, str(tmp_path))
    for i in range(4):
        batch = sent(spark, *[over(100 * i + k, 1 + 5 * i) for k in range(20)])
        store.add_matches(batch, i, small.game_names, small.players, AS_OF)
    asked = spark.createDataFrame([(105,), (9999,)], "match_id bigint")
    assert 1 in store.match_index.folders(asked, "match_id", before=4) and store.match_index.folders(asked, "match_id", before=1) in ([], [0])
    found = store._stored_matches(batches=store.match_index.folders(asked, "match_id", 4))
    opened = {f.split("batch_id=")[1].split("/")[0] for f in found.inputFiles()}
    assert "1" in opened and len(opened) < 4
    assert [r.match_id for r in store.known(asked, 4).collect()] == [105]
    days = spark.createDataFrame([("2024-06-06",)], "d string").select(F.col("d").cast("date").alias("day"))
    assert store.match_index.folders_of_days(days, "day", 4) == [1]
    # a repeat from any time is found
    store.add_matches(sent(spark, over(3, 1), over(303, 16), over(900, 17)), 4, small.game_names, small.players, AS_OF)
    assert store.matches().count() == 81


def test_index_of_text_ids_and_of_nothing(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path))
    ids = spark.createDataFrame([("a-1",), ("b-2",), (None,)], "id string")
    assert index.folders(ids, "id") == []
    index.add(ids.limit(0), "id", 0)
    index.add(ids, "id", 1)
    assert index.folders(ids, "id") == [1] and index.folders(ids.where("id is null"), "id") == []


def test_filters_lose_nothing_and_let_few_through(spark):
    keys = spark.range(0, 20_001, 4).withColumnRenamed("id", "k")
    rows_ = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    kept = {r.a for r in bloom.may_match(rows_, ["a", "b"], keys, "k").collect()}
    assert {i for i in range(20_000) if i % 4 == 0 or (i + 1) % 4 == 0} <= kept and len(kept) < 11_000


def test_repeats_in_the_stream_state(spark, small, tmp_path):
    inbox, store = str(tmp_path / "inbox"), I.EventStore(spark, str(tmp_path / "tables"))
    for part in ([over(1, 1), over(1, 1), ("game.over", "{")], [over(1, 1), ("game.over", "{"), over(2, 2)]):
        sent(spark, *part).coalesce(1).write.mode("append").json(inbox)
        stream = I.message_stream(spark, inbox, 1)
        I.start_match_ingest(stream, store, small.game_names, small.players, str(tmp_path / "cp"), AS_OF).awaitTermination()
    assert sorted(r.match_id for r in store.matches().collect()) == [1, 2]
    assert store.rejected().count() == 1  # the second one was dropped before it was looked at
