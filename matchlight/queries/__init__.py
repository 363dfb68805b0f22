"""Named queries over the domain, each with independent check SQL where SQL can express it."""

from matchlight.queries import (  # noqa: F401
    activity,
    events,
    features,
    frames,
    models,
    quality,
    reports,
    rollups,
    synthetic,
)
from matchlight.queries.base import callables, oracles

__all__ = ["callables", "oracles"]
