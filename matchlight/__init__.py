"""Match and player analytics for two-player game platforms, on Spark."""

from matchlight.domain import Domain
from matchlight.session import build_session

__all__ = ["Domain", "build_session"]
