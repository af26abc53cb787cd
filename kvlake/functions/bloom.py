"""Membership filters over keys as bitmaps, built and probed by built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP_BITS = 32768
#: Bytes of bitmaps up to which they are sent to all tasks; larger ones are joined.
BROADCAST_BYTES = 64 << 20


def hash_count(bits_per_key: int) -> int:
    return min(30, max(1, int(bits_per_key * 0.69)))


def _positions(key: Column, k: int, size: int) -> Column:
    first, step = F.pmod(F.xxhash64(key), F.lit(1 << 40)), F.pmod(F.xxhash64(F.lit("step"), key), F.lit(1 << 40))
    return F.array(*[F.pmod(first + i * step, F.lit(size)) for i in range(k)])


def build_bloom(keys: DataFrame, count: int, bits_per_key: int = 10) -> tuple[DataFrame, int, int]:
    """Bitmaps ``(bucket, bits)`` of ``keys(key)``, with the hashes per key and the size."""
    k, size = hash_count(bits_per_key), max(64, count * bits_per_key)
    size = math.ceil(size / BITMAP_BITS) * BITMAP_BITS
    spots = keys.select(F.explode(_positions(F.col("key"), k, size)).alias("at"))
    built = spots.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    return built, k, size


def probe_bloom(probes: DataFrame, bloom: tuple[DataFrame, int, int]) -> DataFrame:
    """``probes(key, ...)`` with ``maybe``: false only for keys that were not added."""
    bitmaps, k, size = bloom
    if size <= BROADCAST_BYTES * 8:
        bitmaps = F.broadcast(bitmaps)
    spots = probes.select("key").distinct().select("key", F.explode(_positions(F.col("key"), k, size)).alias("at"))
    spots = spots.select("key", F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("place")).join(bitmaps, "bucket", "left")
    bit = F.expr("coalesce(shiftright(cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) & 1, 0)")
    answers = spots.groupBy("key").agg(F.min(bit).alias("m"))
    return probes.join(answers, "key").withColumn("maybe", F.col("m") == 1).drop("m")
