"""Codecs of keys and integers, as columns and in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ALL_ONES = (1 << 64) - 1


def encode_internal_key(key: bytes, sequence: int, value_type: int) -> bytes:
    """Key, inverted big-endian sequence, type.

    Never sort by it: where one key is a prefix of another, the bytes that follow
    it are compared with those of the longer key.
    """
    return key + (_ALL_ONES - sequence).to_bytes(8, "big") + bytes([value_type])


def decode_internal_key(data: bytes) -> tuple[bytes, int, int] | None:
    if len(data) < 9 or data[-1] > 1:
        return None
    return data[:-9], _ALL_ONES - int.from_bytes(data[-9:-1], "big"), data[-1]


def encode_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def decode_varint(data: bytes) -> tuple[int, int] | None:
    """Value and bytes used; None if cut off or over 64 bits."""
    value = 0
    for i, byte in enumerate(data[:10]):
        value |= (byte & 127) << 7 * i
        if byte < 128:
            return (value, i + 1) if value <= _ALL_ONES else None
    return None


def internal_key(key: Column, sequence: Column, value_type: Column) -> Column:
    """The encoded key as a binary column."""
    return F.concat(key.cast("binary"), F.unhex(F.lpad(F.hex(F.bitwise_not(sequence)), 16, "0")), F.unhex(F.lpad(F.hex(value_type), 2, "0")))


def varint(value: Column) -> Column:
    """A long as a variable-length integer in hex; negative ones as their 64 unsigned bits."""
    bits = F.length(F.bin(value))
    last = F.floor((bits - 1) / 7).cast("int")

    def byte(i: Column) -> Column:
        low = F.call_function("shiftrightunsigned", value, i * 7).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(F.when(i < last, low.bitwiseOR(F.lit(128))).otherwise(low)), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), last), byte), "")


def shared_prefix(key: Column, before: Column) -> Column:
    """Length of the prefix that two string keys share."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(key), F.length(before))))
    return F.size(F.filter(steps, lambda i: (i <= F.length(before)) & (i <= F.length(key)) & (F.substring(key, F.lit(1), i) == F.substring(before, F.lit(1), i))))


def block_prefixes(keys: DataFrame, restart: int = 16) -> DataFrame:
    """Shared prefix with the key before in ``(block, key)``, reset every ``restart`` keys."""
    order = Window.partitionBy("block").orderBy("key")
    rows = keys.withColumn("position", F.row_number().over(order) - 1).withColumn("before", F.lag("key").over(order))
    shared = F.when(F.col("position") % restart == 0, 0).otherwise(shared_prefix(F.col("key"), F.col("before")))
    return rows.select("block", "key", "position", shared.alias("shared"))
