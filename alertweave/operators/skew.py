"""Joins between rows and the compact states of their keys when a key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys count as hot, so their states are a bounded broadcast.
MOST_HOT = 1000


def hot_rows(total: int, least: int = 10_000) -> int:
    """From this many rows on a key is hot; at most MOST_HOT keys of ``total`` rows can be."""
    return max(least, -(-total // MOST_HOT))


def join_states(rows: DataFrame, states: DataFrame, keys: Sequence[str], n: str, total: int, least: int = 10_000) -> DataFrame:
    """Inner join of ``rows`` with ``states``, one row for each key with its number of rows in ``n``.

    States of hot keys (at most MOST_HOT) are broadcast, so their rows stay where they are; all other keys
    shuffle, and none of them has ``hot_rows`` rows.  Null keys match nothing.
    """
    limit = hot_rows(total, least)
    hot = states.where(F.col(n) >= limit)
    calm = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(states.where(F.col(n) < limit), list(keys))
    return calm.unionByName(rows.join(F.broadcast(hot), list(keys)))
