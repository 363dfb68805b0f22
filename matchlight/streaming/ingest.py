"""Streaming ingest of match and sign-up messages into tables, with corrections and deletions.

Each micro-batch writes its own ``batch_id=<n>`` folders with overwrite, so a batch that is
retried after a failure replaces its own output and nothing else; the stream checkpoint takes the
place of the queue's acknowledgement.

Repeats. Exact repeats that arrive within ``REPEATS_WITHIN`` are dropped by the stream's own state. All others are
found through the Bloom filters of earlier batches: only folders that may hold an incoming id are opened.

Changes. A correction or a deletion is a row of ``match_changes``; readers apply the last one of each match. Statistics are
additive parts per player, game and day: a change takes the old match off with negative counts and adds the new
one. The first and last time of a day cannot be taken off, so a part that takes something off states them
anew, from the folders whose range of days holds that day. No other history is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchlight import schemas
from matchlight.operators import changes, rollup
from matchlight.operators.participants import participants
from matchlight.sources.idindex import IdIndex
from matchlight.sources.tables import VersionedTable
from matchlight.streaming import events

STATS_PARTS = (
    "player_id bigint, game_id int, day date, total_games_played bigint, total_wins bigint, "
    "total_losses bigint, total_draws bigint, total_moves bigint, "
    "total_time_played_minutes bigint, first_played timestamp_ntz, last_played timestamp_ntz, restated boolean"
)
STORED_MATCHES = f"{schemas.MATCHES}, player1_moves bigint, player2_moves bigint"
MATCH_CHANGES = f"{STORED_MATCHES}, deleted boolean, changed_at timestamp_ntz"
KEY, DAY_KEY = ["player_id", "game_id"], ["player_id", "game_id", "day"]
CORRECTED, DELETED = "game.corrected", "game.deleted"
REPEATS_WITHIN = "1 hour"
# The state of a stream lies in RocksDB on the disks of the executors, within a bound of memory, instead of their heaps.
# A shuffle's files go with the step that read them, not when the driver next collects garbage.
STATE = "spark.sql.streaming.stateStore"
STREAM_SETTINGS = {
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{STATE}.maintenanceInterval": "15s",  # the local files of a stream that ended go then
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def message_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """Messages from a folder of JSON lines."""
    reader = spark.readStream.schema(schemas.MESSAGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Messages from Kafka, the record key being the routing key (needs the Kafka package)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
        .select(F.col("key").cast("string").alias("routing_key"), F.col("value").cast("string").alias("body"))
    )


def without_repeats(messages: DataFrame, within: str = REPEATS_WITHIN) -> DataFrame:
    """Drop messages equal to one that arrived up to ``within`` before.

    The watermark is on the time of arrival, so no message is ever too late; a message with the same id
    and another text is another message.
    """
    arrived = messages.withColumn("arrived", F.current_timestamp()).withColumn(
        "message_key", F.unhex(F.sha2(F.concat_ws("\n", *messages.columns), 256))
    )
    kept = arrived.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["message_key"])
    return kept.select(*messages.columns)


class EventStore:
    """The tables the ingest keeps, as parquet folders partitioned by batch."""

    def __init__(
        self, spark: SparkSession, root: str, match_id_type: str = "bigint", player_id_type: str = "bigint"
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.match_id_type = match_id_type
        self.player_id_type = player_id_type
        self.match_index = IdIndex(spark, f"{self.root}/match_index")
        self.change_index = IdIndex(spark, f"{self.root}/change_index")
        self.player_index = IdIndex(spark, f"{self.root}/player_index")

    def _typed(self, schema: str) -> str:
        """The schema with the store's types of ids."""
        schema = schema.replace("match_id bigint", f"match_id {self.match_id_type}")
        for name in ("player_id", "player1_id", "player2_id", "winner_id"):
            schema = schema.replace(f"{name} bigint", f"{name} {self.player_id_type}")
        return schema

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        path, schema = f"{self.root}/{name}", self._typed(schema)
        if not self._exists(path):
            return self.spark.createDataFrame([], f"{schema}, batch_id bigint")
        df = self.spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
        return df if before is None else df.filter(F.col("batch_id") < before)

    def _open(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        """Some batch folders of a table, and no others."""
        schema = f"{self._typed(schema)}, batch_id bigint"
        if not batches:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{name}/batch_id={b}" for b in batches]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _path(self, path: str):
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(context._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        files, target = self._path(path)
        return files.exists(target)

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def _stage(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Store an intermediate table of this batch; that of the batch before, which is committed, goes."""
        files, old = self._path(f"{self.root}/{name}/batch_id={batch_id - 1}")
        files.delete(old, True)
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}/batch_id={batch_id}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}/batch_id={batch_id}")

    # --- reading --------------------------------------------------------------------------------

    def _stored_matches(self, before: int | None = None, batches: list[int] | None = None) -> DataFrame:
        if batches is not None:
            return self._open("match_history", STORED_MATCHES, batches)
        return self._read("match_history", STORED_MATCHES, before)

    def _last_changes(self, changed: DataFrame) -> DataFrame:
        """The change of each match that counts: a deletion for good, or else the last correction."""
        order = F.struct("deleted", F.coalesce("changed_at", F.lit("0001-01-01").cast("timestamp_ntz")), "batch_id")
        row = F.max_by(F.struct(*changed.columns), order)
        return changed.groupBy("match_id").agg(row.alias("row")).select("row.*")

    def _apply(self, rows: DataFrame, changed: DataFrame) -> DataFrame:
        """Matches as the last change of each left them; ``rows`` has a row per match."""
        columns = [c for c in rows.columns if c not in ("match_id", "batch_id")]
        last = self._last_changes(changed).select("match_id", F.struct(*columns, "deleted").alias("new"))
        joined = rows.join(last, "match_id", "left").where("new is null or not new.deleted")
        now = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
        return joined.select("match_id", *now)

    def _current(self, before: int | None = None) -> DataFrame:
        rows = self._stored_matches(before)
        if not self._exists(f"{self.root}/match_changes"):
            return rows.drop("batch_id")
        return self._apply(rows, self._read("match_changes", MATCH_CHANGES, before))

    def matches(self, before: int | None = None) -> DataFrame:
        return self._current(before).drop("player1_moves", "player2_moves")

    def moves(self) -> DataFrame:
        return moves_of(self._current())

    def players(self, before: int | None = None) -> DataFrame:
        return self._read("players", schemas.PLAYERS, before).drop("batch_id")

    def rejected(self) -> DataFrame:
        return self._read("quarantine", "body string, reject_reason string").drop("batch_id")

    def rejected_signups(self) -> DataFrame:
        return self._read("signup_quarantine", "body string, reject_reason string").drop("batch_id")

    def ratings(self) -> DataFrame:
        return self._read("player_ratings", "player_id bigint, game_id int, rating int, rating_date date")

    def stats(self, upto: int | None = None) -> DataFrame:
        """The current statistics: all parts added up. Players without a match left have no row."""
        return merge_parts(self._stats_parts(upto))

    def _stats_parts(self, upto: int | None) -> DataFrame:
        """The last compacted table not after ``upto`` and the parts after it, with their batch."""
        end = None if upto is None else upto + 1
        parts = self._read("player_game_stats", STATS_PARTS, end)
        base = self.compacted.latest(before=end)
        if base is None:
            return parts
        compacted = self.compacted.read(before=end).withColumn("batch_id", F.lit(base).cast("bigint"))
        return compacted.unionByName(parts.filter(F.col("batch_id") > base))

    @property
    def compacted(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/player_game_stats_compacted")

    def compact(self, upto: int) -> None:
        """Add up the parts of all batches up to ``upto`` by day into one table, to be run now and then."""
        whole = by_day(self._stats_parts(upto)).where("total_games_played <> 0").withColumn("restated", F.lit(True))
        self.compacted.write(whole, upto)

    # --- writing --------------------------------------------------------------------------------

    def known(self, ids: DataFrame, before: int) -> DataFrame:
        """The match ids among ``ids`` that earlier batches stored."""
        folders = self.match_index.folders(ids, "match_id", before)
        return self._stored_matches(batches=folders).select("match_id").join(ids, "match_id", "left_semi")

    def known_players(self, ids: DataFrame, before: int) -> DataFrame:
        folders = self.player_index.folders(ids, "player_id", before)
        return self._open("players", schemas.PLAYERS, folders).select("player_id").join(ids, "player_id", "left_semi")

    def add_matches(
        self, batch: DataFrame, batch_id: int, games: DataFrame, players: DataFrame, as_of
    ) -> None:
        """Check, dedupe and store the match messages of one micro-batch, new ones and changes, and add their statistics."""
        # The messages are parsed once and stored; each step below reads what the last one stored.
        decoded = self._stage(events.decode_match_events(batch), "staged_messages", batch_id)
        if not decoded.head(1):
            return
        key = F.coalesce("routing_key", F.lit(""))
        deletions = events.check_deletions(decoded.where(key == DELETED), self.match_id_type)
        rest = decoded.where(key != DELETED)
        checked = events.check_match_events(rest, games, players, match_id_type=self.match_id_type)
        events_read = self._stage(checked, "staged_events", batch_id)
        new = events_read.where(key != CORRECTED)
        fresh = changes.one_of(events.good_matches(new), ["match_id"], [F.col("start_time")])
        ids = fresh.select("match_id")
        fresh = fresh.join(self.known(ids, batch_id), "match_id", "left_anti")
        self._write(fresh.sortWithinPartitions("start_time"), "match_history", batch_id)
        stored = self._stored_matches(batches=[batch_id]).drop("batch_id")
        self.match_index.add(stored.withColumn("day", F.to_date("start_time")), "match_id", batch_id, "day")
        parts = parts_of(stored, 1)

        # Most batches change nothing; then nothing more is looked up.
        corrected = events_read.where(key == CORRECTED)
        rejects = events.quarantine(events_read).unionByName(events.quarantine(deletions))
        asked = self._stage(self._asked(corrected, deletions), "staged_changes", batch_id)
        if asked.head(1):
            effect = self._stage(self._effect(asked, batch_id), "staged_effect", batch_id)
            rejects = rejects.unionByName(
                effect.where("reject_reason is not null").select("body", "reject_reason")
            )
            parts = self._changed_parts(parts, effect.where("applies"), batch_id)
        self._write(rejects, "quarantine", batch_id)
        self._write(parts, "player_game_stats", batch_id)
        written = self._open("player_game_stats", STATS_PARTS, [batch_id])
        touched = self._stats_parts(batch_id).join(written.select(*KEY).distinct(), KEY, "left_semi")
        rated = changes.rating_history(rollup.with_scores(merge_parts(touched), as_of), as_of, batch_id)
        self._write(rated.drop("batch_id"), "player_ratings", batch_id)

    def _asked(self, corrected: DataFrame, deletions: DataFrame) -> DataFrame:
        """The one change of each match that a batch asks for."""
        at = events.event_time(F.col("changedAt"))
        good = corrected.where("reject_reason is null").withColumn("changed_at", at)
        rows = events.good_matches(good, "body", "changed_at").withColumn("deleted", F.lit(False))
        empty = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in ("match_id", "body", "changed_at", "deleted")]
        gone = deletions.where("reject_reason is null").select("match_id", *empty, "body", at.alias("changed_at"), F.lit(True).alias("deleted"))
        both = rows.unionByName(gone)
        return changes.one_of(both, ["match_id"], [F.col("deleted"), F.col("changed_at")], last=True)

    def _effect(self, asked: DataFrame, batch_id: int) -> DataFrame:
        """Each asked change beside the match as it is: whether it applies, or why not."""
        ids = asked.select("match_id")
        stored = self._stored_matches(batches=sorted({*self.match_index.folders(ids, "match_id", batch_id), batch_id}))
        rows = stored.join(ids, "match_id", "left_semi").drop("batch_id")
        changed = self._open("match_changes", MATCH_CHANGES, self.change_index.folders(ids, "match_id", batch_id))
        last = self._last_changes(changed.join(ids, "match_id", "left_semi"))
        columns = [c for c in rows.columns if c != "match_id"]
        first = rows.select("match_id", F.struct(*columns).alias("was"))
        after = last.select("match_id", F.struct(*columns).alias("became"), F.col("deleted").alias("was_deleted"), F.col("changed_at").alias("was_changed_at"))
        joined = asked.join(first, "match_id", "left").join(after, "match_id", "left")
        old = F.coalesce("became", "was")
        early = F.coalesce(F.col("changed_at") < F.col("was_changed_at"), F.col("changed_at").isNull() & F.col("was_changed_at").isNotNull())
        same = old.eqNullSafe(F.struct(*columns))
        reason = F.when(F.col("was").isNull(), "unknown_match").when(F.coalesce("was_deleted", F.lit(False)) & ~F.col("deleted"), "deleted_match")
        applies = reason.isNull() & F.when(F.col("deleted"), ~F.coalesce("was_deleted", F.lit(False))).otherwise(~early & ~same)
        return joined.select(*asked.columns, old.alias("old"), reason.alias("reject_reason"), F.coalesce(applies, F.lit(False)).alias("applies"))

    def _changed_parts(self, added: DataFrame, effect: DataFrame, batch_id: int) -> DataFrame:
        """The parts of a batch with changes; stores the changes, too."""
        columns = [f.split()[0] for f in MATCH_CHANGES.split(", ")]
        self._write(effect.select(*columns), "match_changes", batch_id)
        written = self._open("match_changes", MATCH_CHANGES, [batch_id])
        self.change_index.add(written.withColumn("day", F.to_date("start_time")), "match_id", batch_id, "day")
        minus = parts_of(effect.select("match_id", "old.*"), -1)
        plus = parts_of(effect.where("not deleted").drop("old"), 1)
        keys = self._stage(minus.select(*DAY_KEY).distinct(), "staged_keys", batch_id)
        return combined(added.unionByName(plus), minus, self._restated(keys, batch_id))

    def _restated(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """First and last time of the given (player, game, day) from the matches of these days.

        Matches are there by their first version or by a change that moved them there; later changes may have moved them on.
        """
        days = keys.select("day").distinct()
        end = batch_id + 1

        def on_days(rows: DataFrame) -> DataFrame:
            return rows.withColumn("day", F.to_date("start_time")).join(days, "day", "left_semi").drop("day")

        stored = on_days(self._stored_matches(batches=self.match_index.folders_of_days(days, "day", end)))
        moved = self._open("match_changes", MATCH_CHANGES, self.change_index.folders_of_days(days, "day", end))
        ids = stored.select("match_id").unionByName(on_days(moved).select("match_id")).distinct()
        ids = self._stage(ids, "staged_ids", batch_id)
        changed = self._open("match_changes", MATCH_CHANGES, self.change_index.folders(ids, "match_id", end))
        last = self._last_changes(changed.join(ids, "match_id", "left_semi"))
        unchanged = stored.join(last.select("match_id"), "match_id", "left_anti").drop("batch_id")
        now = unchanged.unionByName(last.where("not deleted").select(*unchanged.columns)).withColumn("day", F.to_date("start_time"))
        seats = participants(now.select("match_id", "game_id", "player1_id", "player2_id", "day", "start_time", "end_time"))
        return seats.join(keys, DAY_KEY, "left_semi").groupBy(*DAY_KEY).agg(
            F.min("start_time").alias("first_played"), F.max("end_time").alias("last_played")
        )

    def add_players(self, batch: DataFrame, batch_id: int) -> None:
        """Store the sign-ups whose player is not there yet, and the rejected ones with a reason."""
        checked = self._stage(events.check_signups(batch, self.player_id_type), "staged_signups", batch_id)
        if not checked.head(1):
            return
        self._write(events.quarantine(checked), "signup_quarantine", batch_id)
        good = changes.one_of(events.good_signups(checked), ["player_id"])
        fresh = good.join(self.known_players(good.select("player_id"), batch_id), "player_id", "left_anti")
        self._write(fresh, "players", batch_id)
        self.player_index.add(self._open("players", schemas.PLAYERS, [batch_id]), "player_id", batch_id)


def moves_of(stored: DataFrame) -> DataFrame:
    seats = [
        F.struct(F.col(player).alias("player_id"), F.col(count).alias("moves_count"))
        for player, count in (("player1_id", "player1_moves"), ("player2_id", "player2_moves"))
    ]
    return stored.select("match_id", F.inline(F.array(*seats)))


def parts_of(matches: DataFrame, sign: int) -> DataFrame:
    """Statistics per player, game and day of some matches, added (1) or taken off (-1)."""
    seats = participants(matches.withColumn("day", F.to_date("start_time")))
    moves = F.when(F.col("seat") == 1, F.col("player1_moves")).otherwise(F.col("player2_moves"))
    won = F.col("winner_id") == F.col("player_id")
    sums = {
        "total_games_played": F.lit(1),
        "total_wins": won.cast("int"),
        "total_losses": (~won).cast("int"),
        "total_draws": F.col("winner_id").isNull().cast("int"),
        "total_moves": moves,
        "total_time_played_minutes": F.col("duration_minutes"),
    }
    return seats.groupBy(*DAY_KEY).agg(
        *[(F.coalesce(F.sum(v), F.lit(0)) * sign).cast("bigint").alias(c) for c, v in sums.items()],
        F.min("start_time").alias("first_played"),
        F.max("end_time").alias("last_played"),
    ).withColumn("restated", F.lit(False))


def combined(added: DataFrame, taken: DataFrame, restated: DataFrame) -> DataFrame:
    """One part per player, game and day; days that lost a match have their times from ``restated``."""
    times = {c: F.lit(None).cast("timestamp_ntz") for c in ("first_played", "last_played")}
    rows = added.unionByName(taken.withColumns({**times, "restated": F.lit(True)}))
    part = rows.groupBy(*DAY_KEY).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in rollup.COUNTS],
        F.min("first_played").alias("first_added"),
        F.max("last_played").alias("last_added"),
        F.max("restated").alias("restated"),
    )
    anew = F.col("restated")
    return part.join(restated, DAY_KEY, "left").select(
        *DAY_KEY,
        *rollup.COUNTS,
        F.when(anew, F.col("first_played")).otherwise(F.col("first_added")).alias("first_played"),
        F.when(anew, F.col("last_played")).otherwise(F.col("last_added")).alias("last_played"),
        "restated",
    )


def by_day(parts: DataFrame) -> DataFrame:
    """Parts with their batch added up per player, game and day.

    Times stated anew replace those of earlier batches. Rows are dealt by player and game, so the sums over days
    that follow need no shuffle of their own.
    """
    day = Window.partitionBy(*DAY_KEY)
    since = F.max(F.when(F.col("restated"), F.col("batch_id"))).over(day)
    rows = parts.repartition(*KEY).withColumn("_counts", F.coalesce(F.col("batch_id") >= since, F.lit(True)))
    return rows.groupBy(*DAY_KEY).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in rollup.COUNTS],
        F.min(F.when(F.col("_counts"), F.col("first_played"))).alias("first_played"),
        F.max(F.when(F.col("_counts"), F.col("last_played"))).alias("last_played"),
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """Add up parts over days; a player without a match left in a game has no row."""
    played = F.col("total_games_played") > 0
    return by_day(parts).groupBy(*KEY).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in rollup.COUNTS],
        F.min(F.when(played, F.col("first_played"))).alias("first_played"),
        F.max(F.when(played, F.col("last_played"))).alias("last_played"),
    ).where("total_games_played > 0")


def start_match_ingest(
    messages: DataFrame,
    store: EventStore,
    games: DataFrame,
    players: DataFrame,
    checkpoint: str,
    as_of,
    once: bool = True,
) -> StreamingQuery:
    """Start the match ingest; ``once`` works off what is there and stops."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        store.add_matches(batch, batch_id, games, players, as_of)

    routed = events.route(messages).filter("handler = 'game'").select("routing_key", "body")
    return _start(without_repeats(routed), handle, checkpoint, once)


def start_signup_ingest(
    messages: DataFrame, store: EventStore, checkpoint: str, once: bool = True
) -> StreamingQuery:
    routed = events.route(messages).filter("handler = 'signup'").select("routing_key", "body")
    return _start(without_repeats(routed), store.add_players, checkpoint, once)


def _start(routed: DataFrame, handle, checkpoint: str, once: bool) -> StreamingQuery:
    """Start with ``STREAM_SETTINGS``, which the stream's own copy of the session keeps; a checkpoint keeps the kind of its state."""
    conf = routed.sparkSession.conf
    before = {key: conf.get(key, None) for key in STREAM_SETTINGS}
    for key, value in STREAM_SETTINGS.items():
        conf.set(key, value)
    try:
        writer = routed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)
