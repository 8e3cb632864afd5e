"""Joins whose small side is checked before it is broadcast, and which split hot keys themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.session import BROADCAST_BYTES


def checked_broadcast(side: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``side`` with a broadcast hint if its counted rows times ``row_bytes`` stay within ``limit``.

    ``side`` should be staged: it is counted.  Beyond the limit it comes back as it is and the join shuffles.
    """
    most = limit // row_bytes
    if side.limit(most + 1).count() <= most:
        return F.broadcast(side)
    return side.hint("merge")


def join_representatives(
    rows: DataFrame, reps: DataFrame, keys: list[str], size: str, hot: int = 200_000, row_bytes: int = 200
) -> DataFrame:
    """Inner join of ``rows`` with ``reps`` (one row a key), where a key may hold most of the rows.

    ``reps`` must be staged and hold the group's ``size``.  Keys of more than ``hot`` rows are few (rows / hot),
    so they are broadcast, after a check, and their rows never move; the others are joined by a shuffle.
    NULL keys match nothing.
    """
    heavy = reps.filter(F.col(size) > hot)
    if heavy.limit(1).count() == 0:
        return rows.join(reps, keys)
    light = reps.filter(F.col(size) <= hot)
    heavy = checked_broadcast(heavy, row_bytes)
    rest = rows.join(heavy.select(*keys), keys, "left_anti")
    return rest.join(light, keys).unionByName(rows.join(heavy, keys))
