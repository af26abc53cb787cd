"""Point lookups, many-key lookups and ordered range scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.operators.resolve import latest, live, visible
from kvlake.schema import VALUE


def get(log: DataFrame, key: bytes | str, snapshot: int | None = None) -> DataFrame:
    """``(key, value)`` of one key, or no row; plans without a shuffle."""
    newest = visible(log.where(F.col("key") == F.lit(key)), snapshot).orderBy(F.col("sequence").desc()).limit(1)
    return newest.where(F.col("value_type") == VALUE).select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``(key, value, found)`` for every distinct key asked for.

    The log is first cut to the wanted keys by a semi join, which Spark turns
    into a broadcast where the keys are few, and only then resolved.
    """
    wanted = keys.select("key").distinct()
    found = live(log.join(wanted, "key", "left_semi"), snapshot).select("key", "value", F.lit(True).alias("found"))
    return wanted.join(found, "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def lookup_status(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``(key, status)``: found, deleted or not_found."""
    wanted = keys.select("key").distinct()
    newest = latest(log.join(wanted, "key", "left_semi"), snapshot).select("key", "value_type")
    status = F.when(F.col("value_type").isNull(), "not_found").when(F.col("value_type") == VALUE, "found").otherwise("deleted")
    return wanted.join(newest, "key", "left").select("key", status.alias("status"))


def in_range(log: DataFrame, start: bytes | str | None, end: bytes | str | None) -> DataFrame:
    """Keys in ``[start, end)``; None leaves an end open."""
    if start is not None:
        log = log.where(F.col("key") >= F.lit(start))
    if end is not None:
        log = log.where(F.col("key") < F.lit(end))
    return log


def scan(log: DataFrame, start: bytes | str | None = None, end: bytes | str | None = None, limit: int | None = None, snapshot: int | None = None) -> DataFrame:
    """Live ``(key, value)`` rows of ``[start, end)``, ascending, at most ``limit``.

    ``start >= end`` and ``limit = 0`` give no row.
    """
    rows = live(in_range(log, start, end), snapshot).select("key", "value").orderBy("key")
    return rows if limit is None else rows.limit(limit)
