"""Compaction policy and rewrites."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.operators.resolve import latest
from kvlake.schema import VALUE, Options


@dataclass(frozen=True)
class RunFile:
    """A sorted run at a level."""

    level: int
    file_number: int
    file_size: int
    entry_count: int
    min_key: bytes
    max_key: bytes
    min_seq: int
    max_seq: int

    def overlaps(self, low: bytes, high: bytes) -> bool:
        return self.min_key <= high and self.max_key >= low


@dataclass(frozen=True)
class Task:
    level: int
    output_level: int
    inputs: tuple[RunFile, ...]


def target_size(level: int, options: Options) -> int:
    return options.base_level_size * options.level_size_multiplier ** (level - 1)


def pick_compaction(files: Sequence[RunFile], options: Options) -> Task | None:
    """Level 0 first, once it has enough runs; else the first level over its target.

    Runs of the output level that overlap the inputs are rewritten with them, so
    levels above 0 stay disjoint.
    """
    level0 = sorted((f for f in files if f.level == 0), key=lambda f: f.file_number)
    if len(level0) >= options.l0_compaction_trigger:
        return _with_overlaps(0, level0, files)
    for level in range(1, options.max_levels - 1):
        held = sorted((f for f in files if f.level == level), key=lambda f: (f.min_key, f.file_number))
        if sum(f.file_size for f in held) > target_size(level, options):
            return _with_overlaps(level, held[:1], files)
    return None


def _with_overlaps(level: int, chosen: list[RunFile], files: Sequence[RunFile]) -> Task:
    low, high = min(f.min_key for f in chosen), max(f.max_key for f in chosen)
    below = [f for f in files if f.level == level + 1 and f.overlaps(low, high)]
    return Task(level, level + 1, tuple(chosen + below))


def needs_compaction(files: Sequence[RunFile], options: Options) -> bool:
    return pick_compaction(files, options) is not None


def may_drop_tombstones(task: Task, files: Sequence[RunFile]) -> bool:
    """Whether no run outside the task can hold an older version of its keys."""
    low, high = min(f.min_key for f in task.inputs), max(f.max_key for f in task.inputs)
    newest = max(f.max_seq for f in task.inputs)
    return not any(f.overlaps(low, high) and f.min_seq < newest for f in files if f not in task.inputs)


def rewrite(log: DataFrame, drop_tombstones: bool, snapshot: int | None = None) -> DataFrame:
    """Rows that a compaction keeps.

    Of each key: the newest version, and if a snapshot is retained, the newest at
    or below it and all above.  A tombstone goes only if nothing older can be
    elsewhere and nothing older is kept here.
    """
    if snapshot is None:
        kept = latest(log)
        return kept.where(F.col("value_type") == VALUE) if drop_tombstones else kept
    above = F.col("sequence") > snapshot
    order = Window.partitionBy("key", above).orderBy(F.col("sequence").desc())
    ranked = log.withColumn("_above", above).withColumn("_rank", F.row_number().over(order))
    kept = ranked.where(F.col("_above") | (F.col("_rank") == 1))
    if drop_tombstones:
        kept = kept.where(F.col("_above") | (F.col("value_type") == VALUE))
    return kept.drop("_above", "_rank")


def stall_status(level0_runs: Column, options: Options) -> Column:
    return F.when(level0_runs >= options.l0_stop_trigger, "STOP").when(level0_runs >= options.l0_slowdown_trigger, "SLOW").otherwise("OK")


def pick_from_files(files: DataFrame, options: Options) -> DataFrame:
    """``pick_compaction`` as a query over run metadata: ``(level, output_level, inputs)``, at most one row.

    ``inputs`` counts the chosen runs and those of the next level that overlap them.
    """
    levels = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    due = F.when(F.col("level") == 0, F.col("files") >= options.l0_compaction_trigger).otherwise(
        (F.col("level") < options.max_levels - 1) & (F.col("bytes") > F.lit(options.base_level_size) * F.pow(F.lit(options.level_size_multiplier), F.col("level") - 1))
    )
    picked = levels.where(due).orderBy("level").limit(1).select("level")
    held = files.join(F.broadcast(picked), "level")
    first = held.where("level > 0").orderBy("min_key", "file_number").limit(1)
    chosen = held.where("level = 0").unionByName(first)
    span = chosen.groupBy("level").agg(F.count("*").alias("n"), F.min("min_key").alias("low"), F.max("max_key").alias("high"))
    span = span.select((F.col("level") + 1).alias("below"), "n", "low", "high")
    met = files.join(F.broadcast(span), (F.col("level") == F.col("below")) & (F.col("min_key") <= F.col("high")) & (F.col("max_key") >= F.col("low")))
    overlaps = met.groupBy("below").agg(F.count("*").alias("more"))
    inputs = (F.col("n") + F.coalesce("more", F.lit(0))).alias("inputs")
    return span.join(overlaps, "below", "left").select((F.col("below") - 1).alias("level"), F.col("below").alias("output_level"), inputs)
