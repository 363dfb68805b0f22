"""Event decoding, quarantine and streaming ingest queries."""

from pyspark.sql import functions as F

from matchlight.operators.changes import first_seen
from matchlight.queries.base import query, r
from matchlight.schemas import MESSAGE
from matchlight.session import scratch_path
from matchlight.sources.tables import read_table, replace
from matchlight.streaming import events as E
from matchlight.streaming import ingest as I

# The broken messages of the fixture, in the order the checks run.
REASON = """case when match_id % 83 = 0 then 'bad_json' when match_id % 71 = 0 then 'missing_field'
  when match_id % 89 = 0 then 'bad_time' when match_id % 97 = 0 then 'unknown_game'
  when match_id % 79 = 0 then 'unknown_player' end"""
GOOD = f"good as (select *, {REASON} as reason from match_history)"
MOVES = """mv as (select match_id, player_id, sum(moves_count) n from match_moves group by all)"""


def all_messages(d):
    return d.match_messages.unionByName(d.signup_messages).unionByName(
        d.score_messages.select("routing_key", "body")
    ).unionByName(d.order_messages)


@query(
    "route_events",
    """select handler, count(*) as messages from (
      select 'game' as handler from match_history union all select 'signup' from players
      union all select 'game' from events union all select 'unrouted' from lineitem) t
    group by handler""",
)
def _(d):
    return E.route(all_messages(d)).groupBy("handler").agg(F.count("*").alias("messages"))


@query(
    "decode_match_event",
    f"""with {MOVES}
    select case when m.match_id % 2 = 1 then cast(m.match_id as varchar) end as event_id,
      case when m.match_id % 2 = 1 then 'game.over' end as event_type,
      cast(m.match_id as varchar) as match_id,
      case when m.match_id % 97 = 0 then 'mahjong' else g.name end as game,
      case when m.match_id % 79 = 0 then '-1' else cast(player1_id as varchar) end as player1_id,
      cast(player2_id as varchar) as player2_id, cast(winner_id as varchar) as winner_id,
      cast(coalesce(a.n, 0) as int) as moves1, cast(coalesce(b.n, 0) as int) as moves2
    from match_history m join games g using (game_id)
    left join mv a on a.match_id = m.match_id and a.player_id = player1_id
    left join mv b on b.match_id = m.match_id and b.player_id = player2_id
    where m.match_id % 83 <> 0""",
)
def _(d):
    return E.decode_match_events(d.match_messages).filter(~F.col("bad_json")).select(
        "event_id",
        "event_type",
        F.col("matchId").alias("match_id"),
        "game",
        F.col("player1Id").alias("player1_id"),
        F.col("player2Id").alias("player2_id"),
        F.col("winnerId").alias("winner_id"),
        F.col("player1MoveCounts").alias("moves1"),
        F.col("player2MoveCounts").alias("moves2"),
    )


def checked(d):
    """The match messages, stored as they would arrive, then decoded and checked."""
    path = scratch_path(d.spark, "messages")
    replace(d.match_messages, path)
    messages = read_table(d.spark, path, MESSAGE)
    return E.check_match_events(E.decode_match_events(messages), d.game_names, d.players)


@query(
    "quarantine_events",
    f"""with {GOOD} select coalesce(reason, 'accepted') as outcome, count(*) as events
    from good group by 1""",
)
def _(d):
    reason = F.coalesce("reject_reason", F.lit("accepted"))
    return checked(d).groupBy(reason.alias("outcome")).agg(F.count("*").alias("events"))


@query(
    "quarantine_bad_ids",
    """select match_id, case when match_id % 37 = 0 then 'bad_id' else 'accepted' end as outcome
    from match_history where match_id % 83 <> 0 and match_id % 71 <> 0 and match_id % 89 <> 0
      and match_id % 97 <> 0 and match_id % 79 <> 0""",
)
def _(d):
    """Ids that are no numbers are rejected; every message is accounted for."""
    good = E.decode_match_events(d.match_messages).filter(~F.col("bad_json"))
    number = F.col("matchId").cast("bigint")
    for divisor in (71, 89, 97, 79):
        good = good.filter(number % divisor != 0)
    spoiled = good.withColumn("number", number).withColumn(
        "matchId", F.when(number % 37 == 0, F.concat(F.lit("m-"), "matchId")).otherwise(F.col("matchId"))
    )
    out = E.check_match_events(spoiled, d.game_names, d.players)
    return out.select(
        F.col("number").alias("match_id"), F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    )


@query(
    "quarantine_signups",
    """select case when player_id % 11 = 0 then 'bad_json' when player_id % 7 = 0 then 'missing_field'
        when player_id % 5 = 0 then 'bad_id' else 'accepted' end as outcome, count(*) as signups
    from players group by 1""",
)
def _(d):
    """Sign-ups through the store, some broken on purpose by divisors of the id."""
    body = F.col("body")
    number = F.coalesce(F.get_json_object(body, "$.userId"), F.get_json_object(body, "$.player_id")).cast("bigint")
    spoiled = (
        F.when(number % 11 == 0, F.left(body, F.lit(20)))
        .when(number % 7 == 0, F.regexp_replace(body, '"username"', '"nickname"'))
        .when(number % 5 == 0, F.regexp_replace(body, '"(userId|player_id)":"', '"$1":"p-'))
        .otherwise(body)
    )
    store = I.EventStore(d.spark, scratch_path(d.spark, "signups"))
    store.add_players(d.signup_messages.select(spoiled.alias("body")), 0)
    outcomes = store.players().select(F.lit("accepted").alias("outcome")).unionByName(
        store.rejected_signups().select(F.col("reject_reason").alias("outcome"))
    )
    return outcomes.groupBy("outcome").agg(F.count("*").alias("signups"))


@query(
    "unknown_game_rejects",
    f"""with {GOOD} select cast(match_id as varchar) as match_id, 'mahjong' as game from good
    where reason = 'unknown_game'""",
)
def _(d):
    return (
        checked(d)
        .filter("reject_reason = 'unknown_game'")
        .select(F.col("matchId").alias("match_id"), "game")
    )


@query(
    "dedupe_matches",
    f"""with {GOOD} select match_id, game_id, player1_id, player2_id, winner_id from good
    where reason is null and match_id % 10 <> 0""",
)
def _(d):
    good = E.good_matches(checked(d))
    stored = d.matches.filter(F.col("match_id") % 10 == 0)
    return first_seen(good.unionByName(good), stored, ["match_id"]).select(
        "match_id", "game_id", "player1_id", "player2_id", "winner_id"
    )


@query(
    "score_events",
    """select 1 + cast(json_extract_string(props, '$.k') as int) % 5 as game_id,
      user_id as player_id, value as score, date_trunc('second', ts) as scored_at from events""",
)
def _(d):
    return d.score_events


@query(
    "battleship_analysis",
    f"""with {MOVES}
    select cast(m.match_id as varchar) as match_id, cast(game_id as varchar) as game_id,
      case when m.match_id % 89 = 0 or m.match_id % 71 = 0 then null
        else cast(duration_minutes * 60 as bigint) end as duration_seconds,
      cast(winner_id as varchar) as winner_id,
      {r('''case when winner_id = player1_id and m.match_id % 79 <> 0 then coalesce(a.n, 0)
        when winner_id = player2_id then coalesce(b.n, 0) end / 5.0''')} as moves_per_ship
    from match_history m
    left join mv a on a.match_id = m.match_id and a.player_id = player1_id
    left join mv b on b.match_id = m.match_id and b.player_id = player2_id
    where m.match_id % 83 <> 0""",
)
def _(d):
    return E.completed_match_analysis(d.match_messages).filter("match_id is not null")


@query(
    "order_fanout",
    """with o as (select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as id,
        'buyer' || cast(l_suppkey % 7 as varchar) || '@example.com' as user_email,
        'part ' || cast(l_partkey as varchar) as product, cast(l_quantity as int) as quantity
      from lineitem)
    select 'order.notify' as target, user_email, cast(null as varchar) as id,
      cast(null as varchar) as product, cast(null as int) as quantity from o
    union all select 'order.report', user_email, id, product, quantity from o""",
)
def _(d):
    return E.order_fanout(d.order_messages)


# --- streams ----------------------------------------------------------------------------------


MESSAGES_PER_FILE = 500_000


def run_match_stream(d, parts: int = 3):
    """Write the messages as JSON files, ingest them as a stream, two files of three at a time, and return the store.

    A compressed file is read by one task, so the number of files follows the number of messages.
    """
    root = scratch_path(d.spark, "match-ingest")
    parts = max(parts, -(-d.matches.count() // MESSAGES_PER_FILE))
    d.match_messages.repartition(parts).write.option("compression", "gzip").json(f"{root}/inbox")
    store = I.EventStore(d.spark, f"{root}/tables")
    stream = I.message_stream(d.spark, f"{root}/inbox", files_per_batch=-(-2 * parts // 3))
    I.start_match_ingest(
        stream, store, d.game_names, d.players, f"{root}/checkpoint", d.as_of
    ).awaitTermination()
    return store


@query(
    "ingest_match_events",
    f"""with {GOOD} select match_id, game_id, player1_id, player2_id, winner_id, start_time, end_time,
      duration_minutes, case when winner_id is null then 'draw' else 'win' end as result
    from good where reason is null""",
)
def _(d):
    return run_match_stream(d).matches()


@query(
    "stream_refresh_stats",
    f"""with {GOOD}, {MOVES}
    select s.player_id, s.game_id, count(*) as total_games_played,
      count(*) filter (s.winner_id = s.player_id) as total_wins,
      count(*) filter (s.winner_id <> s.player_id) as total_losses,
      count(*) filter (s.winner_id is null) as total_draws,
      cast(coalesce(sum(n), 0) as bigint) as total_moves,
      cast(sum(s.duration_minutes) as bigint) as total_time_played_minutes,
      min(s.start_time) as first_played, max(s.end_time) as last_played
    from seats s join good g on g.match_id = s.match_id and g.reason is null
    left join mv on mv.match_id = s.match_id and mv.player_id = s.player_id
    group by s.player_id, s.game_id""",
)
def _(d):
    return run_match_stream(d).stats()


CORRECTED = f"""{GOOD}, {MOVES},
    now as (select match_id, game_id, player1_id, player2_id,
        case when match_id % 77 = 0 then null when match_id % 50 = 0 then player1_id else winner_id end as winner_id,
        start_time - case when moved then interval 1 day else interval 0 day end as start_time,
        end_time - case when moved then interval 1 day else interval 0 day end
          + case when moved then interval 7 minute else interval 0 minute end as end_time,
        duration_minutes + case when moved then 7 else 0 end as duration_minutes
      from (select *, match_id % 50 = 0 and match_id % 77 <> 0 as moved from good where reason is null)),
    now_seats as (select *, player1_id as player_id from now
      union all select *, player2_id from now where player2_id <> player1_id)"""
CORRECTED_STATS = """select s.player_id, s.game_id, count(*) as total_games_played,
      count(*) filter (s.winner_id = s.player_id) as total_wins,
      count(*) filter (s.winner_id <> s.player_id) as total_losses,
      count(*) filter (s.winner_id is null) as total_draws,
      cast(coalesce(sum(n), 0) as bigint) as total_moves,
      cast(sum(s.duration_minutes) as bigint) as total_time_played_minutes,
      min(s.start_time) as first_played, max(s.end_time) as last_played
    from now_seats s left join mv on mv.match_id = s.match_id and mv.player_id = s.player_id"""


def run_changes(d, *messages):
    """The messages of matches through a stream, then more messages through the same stream."""
    root = scratch_path(d.spark, "match-changes")
    store = I.EventStore(d.spark, f"{root}/tables")
    for part in (d.match_messages, *messages):
        # No fewer tasks than the tables have: one that works off many partitions adds up their memory.
        part.write.mode("append").option("compression", "gzip").json(f"{root}/inbox")
        stream = I.message_stream(d.spark, f"{root}/inbox")
        I.start_match_ingest(stream, store, d.game_names, d.players, f"{root}/checkpoint", d.as_of).awaitTermination()
    return store


@query("stream_corrections", f"with {CORRECTED} {CORRECTED_STATS} group by s.player_id, s.game_id")
def _(d):
    """Statistics after corrections went through the stream, some of them twice."""
    again = d.correction_messages.filter(F.xxhash64("body") % 3 == 0)
    return run_changes(d, d.correction_messages, again).stats()


@query(
    "stream_deletes",
    f"with {CORRECTED} {CORRECTED_STATS} where s.match_id % 101 <> 0 group by s.player_id, s.game_id",
)
def _(d):
    """Statistics after corrections and deletions went through the stream in one batch."""
    return run_changes(d, d.correction_messages.unionByName(d.deletion_messages)).stats()


@query(
    "corrected_matches",
    f"with {CORRECTED} select * from now where match_id % 101 <> 0",
)
def _(d):
    """The match table after corrections and deletions, applied while reading."""
    return run_changes(d, d.correction_messages, d.deletion_messages).matches().drop("result")


@query(
    "ingest_signups",
    """select player_id, username, firstname, lastname,
      case when player_id % 2 = 0 then 'mail.' || email else username || '@example.com' end as email,
      birthdate, gender, country from players""",
)
def _(d):
    root = scratch_path(d.spark, "signup-ingest")
    messages = d.signup_messages.unionByName(d.signup_messages)
    messages.repartition(2).write.json(f"{root}/inbox")
    store = I.EventStore(d.spark, f"{root}/tables")
    stream = I.message_stream(d.spark, f"{root}/inbox", files_per_batch=1)
    I.start_signup_ingest(stream, store, f"{root}/checkpoint").awaitTermination()
    return store.players()
