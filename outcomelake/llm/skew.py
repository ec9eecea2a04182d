"""Joins of many rows with one row a key, whatever share of the rows a key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are sent to all executors at most.
BROADCAST_KEYS = 100_000


def joined_by_count(rows: DataFrame, keyed: DataFrame, on: list[str], count_col: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row a key and in ``count_col`` how many rows hold it.

    Up to :data:`BROADCAST_KEYS` keys are sent to all tasks. Of more keys only those that hold more than the
    total's share of one in :data:`BROADCAST_KEYS` are sent: there are fewer than that many of them, however
    large the input. All others are joined by a shuffle, in which no key has more rows than that share. ``keyed``
    is read several times, so it should be a written table. Null keys match nothing.
    """
    keys, total = keyed.agg(F.count("*"), F.coalesce(F.sum(count_col), F.lit(0))).first()
    if keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keyed), on)
    hot = F.col(count_col) > F.lit(total / BROADCAST_KEYS)
    often, seldom = keyed.where(hot), keyed.where(~hot)
    rest = rows.join(F.broadcast(often.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(often), on).unionByName(rest.join(seldom, on))


def left_joined_by_count(rows: DataFrame, keyed: DataFrame, on: str, count_col: str) -> DataFrame:
    """The same as a left join by one key; rows without a key, or with one that ``keyed`` lacks, get nulls.

    Rows without a key pass by the join, so that they never meet in one task.
    """
    keys, total = keyed.agg(F.count("*"), F.coalesce(F.sum(count_col), F.lit(0))).first()
    if keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keyed), on, "left")
    hot = F.col(count_col) > F.lit(total / BROADCAST_KEYS)
    often, seldom = keyed.where(hot), keyed.where(~hot)
    given = rows.where(F.col(on).isNotNull())
    rest = given.join(F.broadcast(often.select(on)), on, "left_anti").join(seldom, on, "left")
    return given.join(F.broadcast(often), on).unionByName(rest).unionByName(rows.where(F.col(on).isNull()), allowMissingColumns=True)
