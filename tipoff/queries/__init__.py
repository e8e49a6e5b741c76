"""All registered queries and their oracle SQL."""

from tipoff.queries import (  # noqa: F401
    evaluation, frames, learning, lineups, rating, relational, scalars, sources, streams, windows,
)
from tipoff.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
