import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from matchlight import build_session  # noqa: E402
from matchlight.domain import Domain  # noqa: E402
from matchlight import schemas  # noqa: E402
from matchlight.session import drop_scratch  # noqa: E402

AS_OF = "2024-06-30 00:00:00"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        4,
        {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """Three players, two games, six matches; one match against oneself, one without moves."""
    from datetime import date, datetime

    def when(day, hour=10, minute=0):
        return datetime(2024, 6, day, hour, minute)

    games = [(1, "battleship", False), (2, "chess", True), (3, "go", False)]
    players = [
        (1, "ann", "Ann", "Lee", "ann@example.com", date(2000, 2, 29), "Female", "USA"),
        (2, "bob", "Bob", "Ray", "bob@example.com", date(1990, 6, 30), "Male", "USA"),
        (3, "cho", "Cho", "Kim", "cho@example.com", date(1990, 7, 1), "Male", "Japan"),
    ]
    matches = [
        (10, 1, 1, 2, 1, when(1), when(1, 10, 20), 20, "win"),
        (11, 1, 2, 1, 1, when(2), when(2, 10, 30), 30, "loss"),
        (12, 2, 1, 3, None, when(3), when(3, 11), 60, "draw"),
        (13, 2, 3, 2, 2, when(4), when(4, 10, 10), 10, "loss"),
        (14, 1, 3, 3, 3, when(5), when(5, 10, 5), 5, "win"),
        (15, 1, 1, 2, 2, when(6), when(6, 10, 15), 15, "loss"),
    ]
    moves = [
        (10, 1, 7), (10, 1, 3), (10, 2, 9), (11, 2, 5), (11, 1, 6),
        (12, 1, 20), (12, 3, 22), (13, 3, 4), (14, 3, 8),
    ]
    return Domain(
        spark,
        AS_OF,
        games=spark.createDataFrame(games, schemas.GAMES),
        players=spark.createDataFrame(players, schemas.PLAYERS),
        matches=spark.createDataFrame(matches, schemas.MATCHES),
        moves=spark.createDataFrame(moves, schemas.MOVES),
    )


def rows(df, *order):
    ordered = df.orderBy(*order) if order else df
    return [tuple(r) for r in ordered.collect()]
