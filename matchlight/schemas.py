"""Explicit schemas (as DDL text) and value domains; nothing is inferred on read."""

from __future__ import annotations

GENDERS = ("Male", "Female", "Non-Binary")
RESULTS = ("win", "loss", "draw")
LEVELS = ("novice", "intermediate", "expert")
RATING_RANGE = (1, 5)


GAMES = "game_id int, name string, can_draw boolean"
PLAYERS = (
    "player_id bigint, username string, firstname string, lastname string, email string, "
    "birthdate date, gender string, country string"
)
MATCHES = (
    "match_id bigint, game_id int, player1_id bigint, player2_id bigint, winner_id bigint, "
    "start_time timestamp_ntz, end_time timestamp_ntz, duration_minutes int, result string"
)
MOVES = "match_id bigint, player_id bigint, moves_count bigint"
RATINGS = "player_id bigint, game_id int, rating int, rating_date date, batch_id bigint"

# One row per player and game with the dimensions, as written by the feature export.
FEATURE_CSV = (
    "player_id bigint, game_id int, username string, age int, gender string, country string, "
    "game_name string, total_games_played bigint, total_wins bigint, total_losses bigint, "
    "win_ratio double, total_moves bigint, total_time_played_minutes bigint, "
    "highest_score double, rating int, churned string, is_churned boolean, player_level string, "
    "win_probability double, last_played timestamp_ntz"
)

MATCH_EVENT = (
    "matchId string, gameId string, game string, player1Id string, player2Id string, "
    "startTime string, endTime string, player1MoveCounts int, player2MoveCounts int, "
    "winnerId string, changedAt string"
)
EVENT_HEADER = "eventID string, eventType string"
MESSAGE = "routing_key string, body string"
# Two shapes of the signup body are in use; column names only differ by case, so each has its own.
SIGNUP_CAMEL = (
    "userId string, username string, firstName string, lastName string, gender string, "
    "country string, birthDate array<int>"
)
SIGNUP_SNAKE = (
    "player_id string, username string, firstname string, lastname string, email string, "
    "birthdate string, gender string, country string"
)
SCORE_EVENT = "gameId string, playerId string, score double, `timestamp` string"
ORDER_EVENT = (
    "id string, user_email string, userEmail string, product string, quantity int"
)
