"""Fold a stream of log rows to the latest state, and commit micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.db import Database
from kvlake.schema import VALUE

#: Requests that one group commit takes at most.
GROUP_COMMIT = 256


def fold_stream(log: DataFrame) -> DataFrame:
    """Newest version per key of a streaming log; state holds one row per key.

    Use output mode ``complete`` or ``update``.  Tombstones stay in the state, as
    a late older version must not bring a key back; ``live_rows`` hides them.
    """
    newest = F.max_by(F.struct("value_type", "value"), "sequence").alias("newest")
    return log.groupBy("key").agg(F.max("sequence").alias("sequence"), newest).select("key", "sequence", "newest.value_type", "newest.value")


def live_rows(state: DataFrame) -> DataFrame:
    return state.where(F.col("value_type") == VALUE).select("key", "value")


def group_commits(log: DataFrame, size: int = GROUP_COMMIT) -> DataFrame:
    """Batch number, rows, and whether any row asks for a sync, of sequence chunks."""
    return log.groupBy(F.floor(F.col("sequence") / size).cast("long").alias("batch")).agg(
        F.count("*").alias("requests"), F.max("needs_sync").alias("needs_sync"), F.min("sequence").alias("first_sequence")
    )


def write_stream(ops: DataFrame, db: Database, ordinal: str, checkpoint: str):
    """Apply each micro-batch of ``(op, key, value, ordinal)`` rows as one atomic write.

    Ordinals must be distinct within a micro-batch; they are shifted to begin at 0.
    The edit that makes a batch visible holds its number, and a number that was
    applied is skipped, so a restart repeats nothing wherever the writer stopped.
    """
    def apply(batch: DataFrame, number: int) -> None:
        if number > db.stream_batch:
            low = batch.agg(F.min(ordinal)).first()[0] or 0
            db.write_frame(batch.withColumn("_place", F.col(ordinal) - F.lit(low)), "_place", stream_batch=number)

    return ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")
