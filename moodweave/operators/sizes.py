"""Broadcasts whose size is looked at first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a side that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def checked(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` marked for broadcast if it has at most ``limit`` rows, else as it is; only a count comes to the driver."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def few_values(column: DataFrame, limit: int) -> list | None:
    """The distinct values of a one-column table, if there are at most ``limit``."""
    found = [r[0] for r in column.distinct().limit(limit + 1).collect()]
    return found if len(found) <= limit else None
