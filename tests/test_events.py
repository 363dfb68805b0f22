import json

import pytest
from conftest import AS_OF, rows
from pyspark.sql import functions as F

from matchlight.domain import Domain
from matchlight.operators import quality as Q
from matchlight.operators import rollup
from matchlight.streaming import events as E
from matchlight.streaming import ingest as I


def event(match_id, **changes):
    body = {
        "matchId": str(match_id), "game": "chess", "player1Id": "1", "player2Id": "3",
        "startTime": "2024-06-20T10:00:00.123456", "endTime": "2024-06-20T10:30:59.9",
        "player1MoveCounts": 11, "player2MoveCounts": 12, "winnerId": "3",
    }
    body.update(changes)
    return json.dumps({k: v for k, v in body.items() if v != "absent"})


MESSAGES = [
    ("game.over", event(100)),
    ("game.over", json.dumps({"eventHeader": {"eventID": "e1", "eventType": "game.over"}, "eventBody": event(101, winnerId=None)})),
    ("game.over", event(102)[:30]),
    ("game.over", event(103, endTime="absent")),
    ("game.over", event(104, startTime="yesterday")),
    ("game.over", event(105, game="mahjong")),
    ("game.over", event(106, player1Id="99")),
    ("game.over", event(107, winnerId="2")),
    ("game.over", event(108, startTime="2024-06-20T10:00:00Z")),
    ("user.signup", json.dumps({"userId": "7", "username": "dee", "firstName": "Dee", "lastName": "Fox", "gender": "Female", "country": "UK", "birthDate": [2001, 2, 3]})),
    ("user.signup", json.dumps({"player_id": "8", "username": "eli", "firstname": "Eli", "lastname": "Gray", "email": "e@x.org", "birthdate": "1999-12-31", "gender": "Male", "country": "UK"})),
    ("order.report", "{}"),
]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(MESSAGES, "routing_key string, body string")


def checked(messages, small):
    game = E.route(messages).filter("handler = 'game'")
    return E.check_match_events(E.decode_match_events(game), small.game_names, small.players, rows_per_task=2)


def test_routing(messages):
    got = dict(rows(E.route(messages).groupBy("handler").count()))
    assert got == {"game": 9, "signup": 2, "unrouted": 1}


def test_reject_reasons(messages, small):
    out = checked(messages, small)
    reasons = {r.matchId: r.reject_reason for r in out.collect()}
    assert reasons == {
        "100": None, "101": None, None: "bad_json", "103": "missing_field", "104": "bad_time",
        "105": "unknown_game", "106": "unknown_player", "107": "unknown_player", "108": None,
    }
    assert E.quarantine(out).count() == 6


def test_good_matches(messages, small):
    got = {r.match_id: r for r in E.good_matches(checked(messages, small)).collect()}
    assert set(got) == {100, 101, 108}
    assert (got[100].duration_minutes, got[100].result, got[100].winner_id) == (30, "win", 3)
    assert (got[101].result, got[101].winner_id) == ("draw", None)


def test_signups_in_both_shapes(messages):
    got = {r.player_id: r for r in E.decode_signups(E.route(messages).filter("handler = 'signup'")).collect()}
    assert str(got[7].birthdate) == "2001-02-03" and got[7].email == "dee@example.com"
    assert str(got[8].birthdate) == "1999-12-31" and got[8].email == "e@x.org"
    assert got[8].firstname == "Eli"


def test_order_fanout(spark):
    bodies = [
        (json.dumps({"id": "a", "user_email": "x@y", "product": "Jacket", "quantity": 1}),),
        (json.dumps({"id": "b", "userEmail": "z@y", "product": "Hat", "quantity": 2}),),
    ]
    got = rows(E.order_fanout(spark.createDataFrame(bodies, "body string")), "target", "user_email")
    assert got == [
        ("order.notify", "x@y", None, None, None), ("order.notify", "z@y", None, None, None),
        ("order.report", "x@y", "a", "Jacket", 1), ("order.report", "z@y", "b", "Hat", 2),
    ]


def test_stream_equals_batch_and_replay_changes_nothing(spark, small, tmp_path):
    """Files arrive one per micro-batch, with every match sent twice."""
    good = [(k, b) for k, b in MESSAGES if k == "game.over"]
    inbox = str(tmp_path / "inbox")
    for part in (good[:5], good[4:], good):
        spark.createDataFrame(part, "routing_key string, body string").coalesce(1).write.mode("append").json(inbox)
    store = I.EventStore(spark, str(tmp_path / "tables"))
    stream = I.message_stream(spark, inbox, files_per_batch=1)
    I.start_match_ingest(stream, store, small.game_names, small.players, str(tmp_path / "cp"), AS_OF).awaitTermination()
    columns = ["player_id", "game_id", *rollup.COUNTS, "first_played", "last_played"]
    assert sorted(r.match_id for r in store.matches().collect()) == [100, 101, 108]
    full = rollup.player_game_stats(store.matches(), store.moves())
    expected = rows(full.select(*columns), "player_id", "game_id")
    assert rows(store.stats().select(*columns), "player_id", "game_id") == expected
    ratings = store.ratings().count()
    # a retried batch writes the same folders again
    first = spark.createDataFrame(good[:5], "routing_key string, body string")
    store.add_matches(first, 0, small.game_names, small.players, AS_OF)
    assert rows(store.stats().select(*columns), "player_id", "game_id") == expected
    assert store.ratings().count() == ratings
    assert store.matches().count() == 3
    store.compact(1)
    assert rows(store.stats().select(*columns), "player_id", "game_id") == expected


def test_signup_stream_adds_each_player_once(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    signups = [(k, b) for k, b in MESSAGES if k == "user.signup"]
    for part in (signups, signups[:1]):
        spark.createDataFrame(part, "routing_key string, body string").coalesce(1).write.mode("append").json(inbox)
    store = I.EventStore(spark, str(tmp_path / "tables"))
    I.start_signup_ingest(I.message_stream(spark, inbox, 1), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.player_id for r in store.players().collect()) == [7, 8]


# --- quality ----------------------------------------------------------------------------------


def test_orphans_and_duplicates(small):
    broken = Domain(
        small.spark, AS_OF, games=small.games.filter("game_id <> 2"), moves=small.moves, matches=small.matches,
        players=small.players.filter("player_id <> 3"),
    )
    got = {(r.rule, r.key): r.n for r in Q.foreign_keys(broken).collect()}
    stated = {k: n for k, n in got.items() if k[0].startswith(("match.", "moves."))}
    assert stated == {
        ("match.game", "2"): 2, ("match.player1", "3"): 2, ("match.player2", "3"): 2,
        ("match.winner", "3"): 1, ("moves.player", "3"): 3,
    }
    # Player 3 has played games 1 and 2, so has two rows of statistics; game 2 has three players.
    assert {k: n for k, n in got.items() if k not in stated} == {
        ("stats.player", "3"): 2, ("stats.game", "2"): 3, ("ratings.player", "3"): 2, ("ratings.game", "2"): 3,
    }
    twice = small.players.unionByName(small.players.limit(1))
    assert Q.duplicates(twice, "id", ["player_id"]).count() == 1


def test_failed_rules(small):
    bad = small.star.withColumn("age", F.lit(130)).withColumn("country", F.lit(None).cast("string"))
    failed = {tuple(r.failed) for r in Q.failed_rules(bad).select("failed").collect()}
    assert ("age_in_range", "country_given") in failed


def test_cascades(small):
    left = Q.delete_players(small, small.players.filter("player_id = 3"))
    assert sorted(r.match_id for r in left["match_history"].collect()) == [10, 11, 15]
    assert {r.match_id for r in left["match_moves"].collect()} == {10, 11}
    left = Q.delete_games(small, small.games.filter("game_id = 1"))
    assert sorted(r.match_id for r in left["match_history"].collect()) == [12, 13]


def test_reconcile(spark):
    sent = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    there = spark.createDataFrame([(2,), (3,), (9,)], "id int")
    assert rows(Q.reconcile(sent, there, "t", "id")) == [("t", 3, 2, 1)]


def test_ids_that_are_no_numbers_and_offsets(spark, small, tmp_path):
    """Nothing is lost: accepted, rejected and repeated events add up to those that came in."""
    texts = [
        event("a-1"), event("B-2 "), event("b-2"), event("", startTime="2024-06-20T12:00:00+02:00"), event("c-3", player1Id="one"),
        event("d-4", winnerId="nobody"), event("e-5", startTime="2024-06-20T08:30:00.5-01:30", endTime="2024-06-20T10:30:59+0000"),
    ]
    batch = spark.createDataFrame([("game.over", t) for t in texts], "routing_key string, body string")
    numbers = {r.matchId: r.reject_reason for r in checked(batch, small).collect()}
    assert set(numbers.values()) == {"bad_id"}
    store = I.EventStore(spark, str(tmp_path / "tables"), match_id_type="string")
    store.add_matches(batch, 0, small.game_names, small.players, AS_OF)
    got = {r.match_id: r for r in store.matches().collect()}
    assert set(got) == {"a-1", "b-2", "e-5"}
    assert str(got["e-5"].start_time) == "2024-06-20 10:00:00" and got["e-5"].duration_minutes == 30
    assert sorted(r.reject_reason for r in store.rejected().collect()) == ["bad_id"] * 3
    assert len(texts) == len(got) + 3 + 1  # one repeat
    assert {r.match_id for r in store.moves().collect()} == set(got)


def test_rejected_signups_are_kept(spark, tmp_path):
    bodies = ['{"userId": "x1", "username": "a"}', '{"userId": "1"}', '{"userId": ', None, '{"userId": "5", "username": "b"}']
    store = I.EventStore(spark, str(tmp_path / "tables"))
    store.add_players(spark.createDataFrame([(b,) for b in bodies], "body string"), 0)
    assert [r.player_id for r in store.players().collect()] == [5]
    assert sorted(r.reject_reason for r in store.rejected_signups().collect()) == ["bad_id", "bad_json", "bad_json", "missing_field"]
    as_text = E.decode_signups(spark.createDataFrame([(b,) for b in bodies], "body string"), "string")
    assert sorted(r.player_id for r in as_text.collect()) == ["5", "x1"]


def test_message_files_follow_the_rows_and_no_task_works_off_many_partitions(spark, monkeypatch):
    from pathlib import Path
    from types import SimpleNamespace

    from matchlight.queries import events as queries

    monkeypatch.setattr(queries.I, "start_match_ingest", lambda *_: SimpleNamespace(awaitTermination=lambda: None))
    monkeypatch.setattr(queries, "MESSAGES_PER_FILE", 10, raising=False)
    messages = spark.range(0, 95, 1, 6).selectExpr("'game.over' as routing_key", "cast(id as string) as body")
    d = SimpleNamespace(spark=spark, match_messages=messages, matches=messages, game_names=None, players=None, as_of=None)

    def files(store):
        inbox = Path(store.root.removeprefix("file:")).parent / "inbox"
        found = [f.name for f in inbox.iterdir() if f.name.startswith("part-")]
        assert spark.read.json(str(inbox)).count() == 95
        return found

    assert len(files(queries.run_changes(d))) == 6
    written = files(queries.run_match_stream(d))
    assert len(written) == 10 and all(name.endswith(".gz") for name in written)


def test_state_lies_on_disk_and_the_session_keeps_its_settings(spark, small, tmp_path):
    inbox, key = str(tmp_path / "inbox"), "spark.sql.streaming.stateStore.providerClass"
    good = [(k, b) for k, b in MESSAGES if k == "game.over"]
    spark.createDataFrame(good + good, "routing_key string, body string").coalesce(1).write.json(inbox)
    before = spark.conf.get(key)
    store = I.EventStore(spark, str(tmp_path / "tables"))
    I.start_match_ingest(I.message_stream(spark, inbox), store, small.game_names, small.players, str(tmp_path / "cp"), AS_OF).awaitTermination()
    files = {f.suffix for f in (tmp_path / "cp" / "state").rglob("*.*") if not f.name.startswith(".")}
    assert ".changelog" in files and ".delta" not in files
    assert spark.conf.get(key) == before and "RocksDB" not in before
    assert sorted(r.match_id for r in store.matches().collect()) == [100, 101, 108]


def test_changes_arrive_in_compressed_files(spark, monkeypatch):
    from pathlib import Path
    from types import SimpleNamespace

    from matchlight.queries import events as queries

    monkeypatch.setattr(queries.I, "start_match_ingest", lambda *_: SimpleNamespace(awaitTermination=lambda: None))
    messages = spark.range(0, 20, 1, 2).selectExpr("'game.over' as routing_key", "cast(id as string) as body")
    d = SimpleNamespace(spark=spark, match_messages=messages, game_names=None, players=None, as_of=None)
    inbox = Path(queries.run_changes(d, messages).root.removeprefix("file:")).parent / "inbox"
    found = [f.name for f in inbox.iterdir() if f.name.startswith("part-")]
    assert len(found) == 4 and all(name.endswith(".gz") for name in found)
    assert spark.read.json(str(inbox)).count() == 40
