"""The game domain read from the TPC-H-like test tables.

Customers are players, orders are matches, line items carry the move counts, order priorities are
the games and events are in-game score messages. The tables stay Spark plans over the parquet
files, so column pruning and filters reach the scans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlight.domain import Domain
from matchlight.streaming.events import decode_scores

# The game behind each order priority, and the games that can end in a draw.
GAME_NAMES = {1: "battleship", 2: "chess", 3: "go", 4: "reversi", 5: "tic tac toe"}
CAN_DRAW = (2, 5)

# With known schemas no job has to read file footers before a query is planned.
TABLE_SCHEMAS = {
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def _game_id():
    return F.substring("o_orderpriority", 1, 1).cast("int")


class SampleTables(Domain):
    """The domain over one folder of test tables; a table is opened when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.sf_dir = sf_dir
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._opened:
            reader = self.spark.read
            if name in TABLE_SCHEMAS:
                reader = reader.schema(TABLE_SCHEMAS[name])
            self._opened[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._opened[name]

    @cached_property
    def games(self) -> DataFrame:
        ids = self.table("orders").select(_game_id().alias("game_id")).distinct()
        name = F.when(F.col("game_id") == 1, GAME_NAMES[1])
        for number in (2, 3, 4):
            name = name.when(F.col("game_id") == number, GAME_NAMES[number])
        return ids.select(
            "game_id",
            name.otherwise(GAME_NAMES[5]).alias("name"),
            F.col("game_id").isin(*CAN_DRAW).alias("can_draw"),
        )

    @cached_property
    def players(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.table("customer")
            .join(
                self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
            )
            .select(
                key.alias("player_id"),
                F.col("c_name").alias("username"),
                F.concat(F.lit("First"), (key % 20).cast("string")).alias("firstname"),
                F.concat(F.lit("Last"), (key % 31).cast("string")).alias("lastname"),
                F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
                F.date_add(F.lit("1950-01-01").cast("date"), ((key * 37) % 18000).cast("int")).alias(
                    "birthdate"
                ),
                F.when(key % 100 == 0, "Non-Binary")
                .when((key % 100).between(1, 10), "Female")
                .otherwise("Male")
                .alias("gender"),
                F.col("n_name").alias("country"),
            )
        )

    @cached_property
    def matches(self) -> DataFrame:
        orders = self.table("orders")
        order, seat1 = F.col("o_orderkey"), F.col("o_custkey")
        seat2 = F.when(order % 29 == seat1, F.lit(29)).otherwise(order % 29)
        winner = F.when(F.col("o_orderstatus") == "F", seat1).when(
            (F.col("o_orderstatus") == "O") | (seat2 % 5 == 0), seat2
        )
        start = F.col("o_orderdate") + F.make_dt_interval(hours=(order % 24).cast("int"))
        minutes = (F.lit(5) + order % 55).cast("int")
        return orders.select(
            order.alias("match_id"),
            _game_id().alias("game_id"),
            seat1.alias("player1_id"),
            seat2.cast("bigint").alias("player2_id"),
            winner.cast("bigint").alias("winner_id"),
            start.alias("start_time"),
            (start + F.make_dt_interval(mins=minutes)).alias("end_time"),
            minutes.alias("duration_minutes"),
            F.when(winner.isNull(), "draw")
            .when(winner == seat1, "win")
            .otherwise("loss")
            .alias("result"),
        )

    @cached_property
    def moves(self) -> DataFrame:
        """Two rows per match. Both seats are summed in one group, so line items shuffle once."""
        seat1 = F.col("l_linenumber") % 2 == 0

        def seat_sum(condition):
            return F.sum(F.when(condition, F.col("l_quantity"))).cast("bigint")

        per_match = (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("match_id"))
            .agg(seat_sum(seat1).alias("m1"), seat_sum(~seat1).alias("m2"))
        )
        seats = self.matches.select("match_id", "player1_id", "player2_id")
        per_seat = [
            F.struct(F.col(player).alias("player_id"), F.col(count).alias("moves_count"))
            for player, count in (("player1_id", "m1"), ("player2_id", "m2"))
        ]
        both = per_match.join(seats, "match_id").select("match_id", F.inline(F.array(*per_seat)))
        return both.filter("moves_count is not null")

    @cached_property
    def score_messages(self) -> DataFrame:
        """Score events as queue messages: a routing key and a JSON body.

        The event type is the last part of the routing key; the property ``k`` picks the game.
        """
        game = F.get_json_object("props", "$.k").cast("int") % 5 + 1
        return self.table("events").select(
            "event_id",
            F.concat(F.lit("game."), F.col("event_type")).alias("routing_key"),
            F.to_json(
                F.struct(
                    game.cast("string").alias("gameId"),
                    F.col("user_id").cast("string").alias("playerId"),
                    F.col("value").alias("score"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                )
            ).alias("body"),
        )

    @cached_property
    def score_events(self) -> DataFrame:
        return decode_scores(self.score_messages)

    @cached_property
    def match_messages(self) -> DataFrame:
        """Finished matches as messages: odd ids inside an envelope, even ids directly.

        A few are broken on purpose, picked by divisors of the id: 83 cuts the JSON text, 89 spoils
        the start time, 97 names an unknown game, 79 an unknown player, 71 drops the end time.
        """
        body = self._match_body(F.col("winner_id"))
        header = F.struct(F.col("match_id").cast("string").alias("eventID"), F.lit("game.over").alias("eventType"))
        envelope = F.to_json(F.struct(header.alias("eventHeader"), body.alias("eventBody")))
        return self.wide.select(
            F.lit("game.over").alias("routing_key"),
            F.when(F.col("match_id") % 2 == 1, envelope).otherwise(body).alias("body"),
        )

    def _match_body(self, winner, days: int = 0, minutes: int = 0, changed_at: str | None = None):
        """The JSON text of a match, ``days`` earlier and ``minutes`` longer than it was."""
        match_id = F.col("match_id")

        def text(column):
            return column.cast("string")

        def iso(name, shift):
            return F.date_format(F.col(name) + shift, "yyyy-MM-dd'T'HH:mm:ss'.123456'")

        earlier = F.make_dt_interval(days=F.lit(-days))
        event = F.struct(
            text(match_id).alias("matchId"),
            text(F.col("game_id")).alias("gameId"),
            F.when(match_id % 97 == 0, "mahjong").otherwise(F.col("game_name")).alias("game"),
            F.when(match_id % 79 == 0, "-1").otherwise(text(F.col("player1_id"))).alias("player1Id"),
            text(F.col("player2_id")).alias("player2Id"),
            F.when(match_id % 89 == 0, "soon").otherwise(iso("start_time", earlier)).alias("startTime"),
            F.when(match_id % 71 != 0, iso("end_time", earlier + F.make_dt_interval(mins=F.lit(minutes)))).alias("endTime"),
            F.coalesce("player1_moves", F.lit(0)).cast("int").alias("player1MoveCounts"),
            F.coalesce("player2_moves", F.lit(0)).cast("int").alias("player2MoveCounts"),
            text(winner).alias("winnerId"),
            *([F.lit(changed_at).alias("changedAt")] if changed_at else []),
        )
        whole = F.to_json(event)
        return F.when(match_id % 83 == 0, F.left(whole, F.lit(25))).otherwise(whole)

    @cached_property
    def correction_messages(self) -> DataFrame:
        """Corrections: ids divisible by 77 lose their winner; of the others, those divisible by 50 were won by the
        first player, a day earlier and seven minutes longer."""
        annulled = F.col("match_id") % 77 == 0
        key = F.lit("game.corrected").alias("routing_key")
        lost = self.wide.filter(annulled).select(key, self._match_body(F.lit(None), changed_at="2001-08-01T00:00:00").alias("body"))
        moved = self.wide.filter(~annulled & (F.col("match_id") % 50 == 0))
        return lost.unionByName(moved.select(key, self._match_body(F.col("player1_id"), 1, 7, "2001-08-01T00:00:00").alias("body")))

    @cached_property
    def deletion_messages(self) -> DataFrame:
        """Deletions of the ids divisible by 101, and of ids that never were."""
        gone = self.wide.filter(F.col("match_id") % 101 == 0).select("match_id")
        never = self.wide.filter(F.col("match_id") % 500 == 0).select((-F.col("match_id")).alias("match_id"))
        body = F.to_json(F.struct(F.col("match_id").cast("string").alias("matchId")))
        return gone.unionByName(never).select(F.lit("game.deleted").alias("routing_key"), body.alias("body"))

    @cached_property
    def signup_messages(self) -> DataFrame:
        """Sign-ups in both body shapes, by odd and even player id."""
        p, text = self.players, F.col("player_id").cast("string")
        parts = [F.year("birthdate"), F.month("birthdate"), F.dayofmonth("birthdate")]
        camel = F.to_json(
            F.struct(
                text.alias("userId"),
                "username",
                F.col("firstname").alias("firstName"),
                F.col("lastname").alias("lastName"),
                "gender",
                "country",
                F.array(*parts).alias("birthDate"),
            )
        )
        snake = F.to_json(
            F.struct(
                text.alias("player_id"),
                "username",
                "firstname",
                "lastname",
                F.concat(F.lit("mail."), "email").alias("email"),
                F.col("birthdate").cast("string").alias("birthdate"),
                "gender",
                "country",
            )
        )
        return p.select(
            F.lit("user.signup").alias("routing_key"),
            F.when(F.col("player_id") % 2 == 1, camel).otherwise(snake).alias("body"),
        )

    @cached_property
    def order_messages(self) -> DataFrame:
        """Line items as order messages, with either spelling of the mail field."""
        mail = F.concat(F.lit("buyer"), (F.col("l_suppkey") % 7).cast("string"), F.lit("@example.com"))
        even = F.col("l_orderkey") % 2 == 0
        return self.table("lineitem").select(
            F.lit("order.placed").alias("routing_key"),
            F.to_json(
                F.struct(
                    F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("id"),
                    F.when(even, mail).alias("user_email"),
                    F.when(~even, mail).alias("userEmail"),
                    F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("product"),
                    F.col("l_quantity").cast("int").alias("quantity"),
                )
            ).alias("body"),
        )
