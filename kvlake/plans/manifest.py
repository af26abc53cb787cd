"""Run metadata and version edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.schema import TRAILER_BYTES
from kvlake.sources.workspace import Workspace


def entry_size() -> str:
    return f"octet_length(key) + {TRAILER_BYTES} + coalesce(octet_length(value), 0)"


def run_stats(log: DataFrame, *by: str) -> DataFrame:
    """One row per run: key and sequence bounds, entries and bytes."""
    return log.groupBy(*by).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entry_count"),
        F.sum(F.expr(entry_size())).cast("long").alias("file_size"), F.min("sequence").alias("min_seq"), F.max("sequence").alias("max_seq"),
    )


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").cast("long").alias("bytes"))


def fold_edits(edits: DataFrame) -> DataFrame:
    """Live files after all edits: the last action on each (level, file) wins.

    Within one edit, deletions come before additions.
    """
    added = edits.select("edit_id", F.lit(1).alias("adds"), F.explode("new_files").alias("f")).select("edit_id", "adds", "f.*")
    gone = edits.select("edit_id", F.lit(0).alias("adds"), F.explode("deleted_files").alias("f")).select("edit_id", "adds", "f.*")
    order = Window.partitionBy("level", "file_number").orderBy(F.col("edit_id").desc(), F.col("adds").desc())
    actions = added.unionByName(gone, allowMissingColumns=True).withColumn("_rank", F.row_number().over(order))
    return actions.where("_rank = 1 and adds = 1").drop("_rank", "adds", "edit_id")


def snapshot_edit(files: DataFrame) -> DataFrame:
    """All live files as one edit; metadata only, so one row holds it."""
    one = F.struct(*[c for c in files.columns])
    return files.agg(F.sort_array(F.collect_list(one)).alias("new_files"))


def may_hold(files: DataFrame, key: bytes | str) -> DataFrame:
    return files.where((F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))


def overlapping(files: DataFrame, start: bytes | str, end: bytes | str) -> DataFrame:
    return files.where((F.col("min_key") < F.lit(end)) & (F.col("max_key") >= F.lit(start)))


def block_index(log: DataFrame, rows_per_block: int, work: Workspace, by: str = "file_number") -> DataFrame:
    """Last key and entries of each block of a run in key order, newest version first.

    Rows are sorted by ranges, so a run of any size is dealt to several tasks; a
    row's place is its place in its range and the rows of the run in earlier ones.
    """
    place = F.monotonically_increasing_id()
    ordered = log.select(by, "key", "sequence").repartitionByRange(by, "key").sortWithinPartitions(F.col(by).asc(), F.col("key").asc(), F.col("sequence").desc())
    ordered = work.table(ordered.select(by, "key", place.alias("place")).withColumn("range", F.shiftright("place", 33)), "ordered")
    parts = ordered.groupBy(by, "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = work.table(parts.select(by, "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "starts")
    rows = ordered.join(starts, [by, "range"])
    block = F.floor((F.col("place") - F.col("first") + F.col("before")) / rows_per_block).cast("int")
    return rows.groupBy(by, block.alias("block")).agg(F.max("key").alias("last_key"), F.count("*").alias("entries"))


def find_block(index: DataFrame, probes: DataFrame, by: str = "file_number") -> DataFrame:
    """First block of each run whose last key is at or after the probe, else the last block.

    Probes and index rows of a run are sorted together, largest key first, so a
    probe's block is the smallest met so far; no probe meets each block.
    """
    rows = index.select(by, F.col("last_key").alias("key"), "block", F.lit(0).alias("probe"))
    asked = probes.where("key is not null").select(by, "key", F.lit(None).cast("int").alias("block"), F.lit(1).alias("probe"))
    sofar = Window.partitionBy(by).orderBy(F.col("key").desc(), "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.unionByName(asked).withColumn("first", F.min("block").over(sofar)).withColumn("top", F.max("block").over(Window.partitionBy(by)))
    found = met.where("probe = 1 and top is not null").select(by, "key", F.coalesce("first", "top").alias("block"))
    return found.groupBy(by, "key").agg(F.min("block").alias("block"))
