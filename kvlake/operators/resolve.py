"""Latest-wins resolution of an append-only log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.schema import VALUE


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Versions at or below the snapshot; all of them without one."""
    return log if snapshot is None else log.where(F.col("sequence") <= snapshot)


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest visible version of every key, tombstones included.

    The rank filter is planned as a group limit before and after the one shuffle,
    so a task sends one row per key, however often the key was written.
    """
    order = Window.partitionBy("key").orderBy(F.col("sequence").desc())
    return visible(log, snapshot).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def live(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest visible version of every key that is not a tombstone."""
    return latest(log, snapshot).where(F.col("value_type") == VALUE)


def tombstones(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return latest(log, snapshot).where(F.col("value_type") != VALUE)


def merge_sources(sources: list[DataFrame]) -> DataFrame:
    """All versions of several inputs as one log; order comes from sequences alone."""
    return reduce(lambda a, b: a.unionByName(b), sources)


def history(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Every version, by key, newest first."""
    return visible(log, snapshot).orderBy(F.col("key").asc(), F.col("sequence").desc())
