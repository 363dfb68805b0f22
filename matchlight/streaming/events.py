"""Decoding, routing and checking of queue messages.

Everything here is a column expression or a join, so the same code runs on a batch and on a stream.
A message has a ``routing_key`` and a JSON ``body``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlight import schemas
from matchlight.functions.numbers import seconds_between
from matchlight.functions.scoring import match_minutes, winner_efficiency
from matchlight.operators.skew import mark_members

TIME_PATTERN = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.\d+)?(?:Z|([+-])(\d{2}):?(\d{2}))?$"
CORRUPT = "_corrupt_record"


def route(messages: DataFrame) -> DataFrame:
    """Add the handler of each message: game events, sign-ups, or none."""
    key = F.col("routing_key")
    handler = F.when(key.startswith("game."), "game").when(key == "user.signup", "signup")
    return messages.withColumn("handler", handler.otherwise("unrouted"))


def event_time(text: Column) -> Column:
    """ISO text to timestamp_ntz in UTC, without its fraction; NULL if it does not parse.

    A time without an offset, or with Z, is UTC already.
    """
    part = [F.regexp_extract(text, TIME_PATTERN, i) for i in range(5)]
    ahead = part[3].try_cast("int") * 60 + part[4].try_cast("int")
    minutes = F.when(part[2] == "+", -ahead).when(part[2] == "-", ahead).otherwise(0)
    whole = F.when(text.rlike(TIME_PATTERN), part[1].try_cast("timestamp_ntz"))
    return (whole + F.make_dt_interval(mins=minutes)).cast("timestamp_ntz")


def typed_id(text: Column, kind: str) -> Column:
    """An id as a key: a number, or text in lower case without outer blanks. NULL if it is neither."""
    if kind == "string":
        return F.nullif(F.lower(F.trim(text)), F.lit(""))
    return F.trim(text).try_cast(kind)


def decode_match_events(messages: DataFrame) -> DataFrame:
    """Fields of match events, sent directly or as text inside an envelope.

    The parsed structs pass through ``explode`` so that each text is parsed once, not once per
    field taken from it.
    """
    envelope = f"eventHeader struct<{_as_fields(schemas.EVENT_HEADER)}>, eventBody string"
    outer = F.from_json("body", f"{envelope}, {schemas.MATCH_EVENT}, {CORRUPT} string", _permissive())
    inner = F.from_json("o.eventBody", f"{schemas.MATCH_EVENT}, {CORRUPT} string", _permissive())
    wrapped = F.col("o.eventBody").isNotNull()
    fields = [f.split()[0] for f in schemas.MATCH_EVENT.split(", ")]
    opened = messages.withColumn("o", once(outer)).withColumn("i", once(inner))
    kept = [c for c in messages.columns if c != "body"]
    return opened.select(
        *kept,
        F.col("o.eventHeader.eventID").alias("event_id"),
        F.col("o.eventHeader.eventType").alias("event_type"),
        *[F.when(wrapped, F.col(f"i.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields],
        (F.col(f"o.{CORRUPT}").isNotNull() | F.col(f"i.{CORRUPT}").isNotNull()).alias("bad_json"),
        "body",
    )


def once(parsed: Column) -> Column:
    return F.explode(F.array(parsed))


def _as_fields(ddl: str) -> str:
    return ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in ddl.split(", "))


def _permissive() -> dict[str, str]:
    return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def check_match_events(
    decoded: DataFrame,
    games: DataFrame,
    players: DataFrame,
    rows_per_task: int | None = None,
    match_id_type: str = "bigint",
) -> DataFrame:
    """Typed match columns plus ``reject_reason``, NULL for a good event.

    Match ids are of ``match_id_type`` (string for ids such as UUIDs), player ids of the type they
    have in ``players``; an id that is there but does not parse is a ``bad_id``.

    ``games`` (game_id, game_name) should be marked for broadcast when small. Players are looked
    up per seat with hot players spread out.
    """
    extra = {"rows_per_task": rows_per_task} if rows_per_task else {}
    known = players.select("player_id")
    player_type = dict(players.dtypes)["player_id"]
    ids = {"match_id": "matchId", "player1_id": "player1Id", "player2_id": "player2Id", "winner_id": "winnerId"}
    kinds = {"match_id": match_id_type}
    typed = decoded.select(
        "*",
        *[typed_id(F.col(raw), kinds.get(c, player_type)).alias(c) for c, raw in ids.items()],
        event_time(F.col("startTime")).alias("start_time"),
        event_time(F.col("endTime")).alias("end_time"),
    )
    named = typed.join(games.withColumnRenamed("game_name", "game"), "game", "left")
    for seat in ("player1_id", "player2_id"):
        named = mark_members(named, known, seat, f"has_{seat}", "body", keys_from=typed, **extra)
    required = ["matchId", "game", "player1Id", "player2Id", "startTime", "endTime"]
    required += ["player1MoveCounts", "player2MoveCounts"]
    missing = F.lit(False)
    for field in required:
        missing = missing | F.col(field).isNull()
    unread = F.lit(False)
    for column, raw in ids.items():
        unread = unread | (F.col(raw).isNotNull() & F.col(column).isNull())
    stranger = (
        ~F.col("has_player1_id")
        | ~F.col("has_player2_id")
        | (
            F.col("winnerId").isNotNull()
            & ~F.coalesce(F.col("winner_id").isin(F.col("player1_id"), F.col("player2_id")), F.lit(False))
        )
    )
    reason = (
        F.when(F.col("bad_json"), "bad_json")
        .when(missing, "missing_field")
        .when(unread, "bad_id")
        .when(F.col("start_time").isNull() | F.col("end_time").isNull(), "bad_time")
        .when(F.col("game_id").isNull(), "unknown_game")
        .when(stranger, "unknown_player")
    )
    return named.withColumn("reject_reason", reason)


def good_matches(checked: DataFrame, *also: str) -> DataFrame:
    """Match rows of the accepted events: a result is a win or, without a winner, a draw."""
    return checked.filter(F.col("reject_reason").isNull()).select(
        "match_id",
        "game_id",
        "player1_id",
        "player2_id",
        "winner_id",
        "start_time",
        "end_time",
        match_minutes(F.col("start_time"), F.col("end_time")).alias("duration_minutes"),
        F.when(F.col("winner_id").isNull(), "draw").otherwise("win").alias("result"),
        F.col("player1MoveCounts").cast("bigint").alias("player1_moves"),
        F.col("player2MoveCounts").cast("bigint").alias("player2_moves"),
        *also,
    )


def check_deletions(decoded: DataFrame, match_id_type: str = "bigint") -> DataFrame:
    """The match id of deletion messages plus ``reject_reason``, NULL for a good one."""
    match_id = typed_id(F.col("matchId"), match_id_type)
    reason = (
        F.when(F.col("bad_json"), "bad_json")
        .when(F.col("matchId").isNull(), "missing_field")
        .when(match_id.isNull(), "bad_id")
    )
    return decoded.withColumn("match_id", match_id).withColumn("reject_reason", reason)


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull()).select("body", "reject_reason")


def check_signups(messages: DataFrame, player_id_type: str = "bigint") -> DataFrame:
    """Player columns from both sign-up shapes plus ``reject_reason``, NULL for a good one.

    A missing e-mail is made from the user name. ``bad_id`` is an id that is there but does not parse.
    """
    corrupt = f"{CORRUPT} string"
    camel = F.from_json("body", f"{schemas.SIGNUP_CAMEL}, {corrupt}", _permissive())
    snake = F.from_json("body", f"{schemas.SIGNUP_SNAKE}, {corrupt}", _permissive())
    opened = messages.withColumn("c", once(camel)).withColumn("s", once(snake))
    day = F.col("c.birthDate")
    from_parts = F.try_to_date(
        F.concat_ws(
            "-",
            F.get(day, 0).cast("string"),
            F.lpad(F.get(day, 1).cast("string"), 2, "0"),
            F.lpad(F.get(day, 2).cast("string"), 2, "0"),
        ),
        "yyyy-MM-dd",
    )
    username = F.coalesce("c.username", "s.username")
    raw_id = F.coalesce("c.userId", "s.player_id")
    player_id = typed_id(raw_id, player_id_type)
    # A value of the wrong kind spoils one shape only; the text is broken if neither can be read.
    broken = F.col("body").isNull() | (F.col(f"c.{CORRUPT}").isNotNull() & F.col(f"s.{CORRUPT}").isNotNull())
    reason = (
        F.when(broken, "bad_json")
        .when(raw_id.isNull() | username.isNull(), "missing_field")
        .when(player_id.isNull(), "bad_id")
    )
    return opened.select(
        player_id.alias("player_id"),
        username.alias("username"),
        F.coalesce("c.firstName", "s.firstname").alias("firstname"),
        F.coalesce("c.lastName", "s.lastname").alias("lastname"),
        F.coalesce(F.col("s.email"), F.concat(username, F.lit("@example.com"))).alias("email"),
        F.coalesce(from_parts, F.try_to_date("s.birthdate", "yyyy-MM-dd")).alias("birthdate"),
        F.coalesce("c.gender", "s.gender").alias("gender"),
        F.coalesce("c.country", "s.country").alias("country"),
        "body",
        reason.alias("reject_reason"),
    )


def good_signups(checked: DataFrame) -> DataFrame:
    """Player rows of the accepted sign-ups."""
    return checked.filter(F.col("reject_reason").isNull()).drop("body", "reject_reason")


def decode_signups(messages: DataFrame, player_id_type: str = "bigint") -> DataFrame:
    return good_signups(check_signups(messages, player_id_type))


def decode_scores(messages: DataFrame) -> DataFrame:
    body = F.from_json("body", schemas.SCORE_EVENT)
    return messages.select(once(body).alias("e")).select(
        F.col("e.gameId").try_cast("int").alias("game_id"),
        F.col("e.playerId").try_cast("bigint").alias("player_id"),
        F.col("e.score").alias("score"),
        event_time(F.col("e.timestamp")).alias("scored_at"),
    )


def completed_match_analysis(messages: DataFrame) -> DataFrame:
    """Duration and the winner's moves per ship of completed-match messages."""
    e = decode_match_events(messages)
    start, end = event_time(F.col("startTime")), event_time(F.col("endTime"))
    return e.select(
        F.col("matchId").alias("match_id"),
        F.col("gameId").alias("game_id"),
        seconds_between(start, end).cast("bigint").alias("duration_seconds"),
        F.col("winnerId").alias("winner_id"),
        winner_efficiency(
            F.col("winnerId"),
            F.col("player1Id"),
            F.col("player2Id"),
            F.col("player1MoveCounts"),
            F.col("player2MoveCounts"),
        ).alias("moves_per_ship"),
    )


def order_fanout(messages: DataFrame) -> DataFrame:
    """One notify row and one report row per order message."""
    opened = messages.select(once(F.from_json("body", schemas.ORDER_EVENT)).alias("e"))
    targets = F.explode(F.array(F.lit("order.notify"), F.lit("order.report")))
    report = F.col("target") == "order.report"
    return opened.select("e.*", targets.alias("target")).select(
        "target",
        F.coalesce("userEmail", "user_email").alias("user_email"),
        F.when(report, F.col("id")).alias("id"),
        F.when(report, F.col("product")).alias("product"),
        F.when(report, F.col("quantity")).alias("quantity"),
    )
