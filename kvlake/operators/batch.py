"""Ordered write batches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.schema import DELETION, OP_DELETE, OP_PUT, VALUE, InvalidArgument


def as_bytes(x: bytes | bytearray | str) -> bytes:
    if isinstance(x, str):
        return x.encode()
    if isinstance(x, (bytes, bytearray, memoryview)):
        return bytes(x)
    raise InvalidArgument(f"keys and values are bytes or text, not {type(x).__name__}")


@dataclass
class WriteBatch:
    """Puts and deletes that take effect together, in order; the last one on a key wins."""

    ops: list[tuple[int, bytes, bytes | None]] = field(default_factory=list)

    def put(self, key: bytes | str, value: bytes | str) -> WriteBatch:
        self.ops.append((OP_PUT, as_bytes(key), as_bytes(value)))
        return self

    def delete(self, key: bytes | str) -> WriteBatch:
        self.ops.append((OP_DELETE, as_bytes(key), None))
        return self

    def __len__(self) -> int:
        return len(self.ops)

    @property
    def is_empty(self) -> bool:
        return not self.ops

    @property
    def packed_bytes(self) -> int:
        """Size of the packed form: type, lengths, key and value of each op."""
        return sum(5 + len(k) + (0 if v is None else 4 + len(v)) for _, k, v in self.ops)

    def rows(self, base: int) -> list[tuple[bytes, int, int, bytes | None]]:
        """Log rows with consecutive sequences from ``base``."""
        return [(k, base + i, VALUE if op == OP_PUT else DELETION, v) for i, (op, k, v) in enumerate(self.ops)]


def expand_batches(batches: DataFrame) -> DataFrame:
    """Log rows of ``(base, ops)``: op i of a batch has sequence ``base + i``."""
    rows = batches.select("base", F.posexplode("ops").alias("pos", "op"))
    kind = F.when(F.col("op.op") == OP_PUT, VALUE).otherwise(DELETION)
    return rows.select(
        F.col("op.key").alias("key"), (F.col("base") + F.col("pos")).alias("sequence"), kind.alias("value_type"),
        F.when(F.col("op.op") == OP_PUT, F.col("op.value")).alias("value"),
    )


def batch_stats(batches: DataFrame) -> DataFrame:
    """Per batch: ops, puts, deletes and bytes of the packed form."""
    puts = F.size(F.filter("ops", lambda o: o["op"] == OP_PUT))

    def packed(o: Column) -> Column:
        return 5 + F.octet_length(o["key"]) + F.when(o["op"] == OP_PUT, 4 + F.octet_length(o["value"])).otherwise(0)

    size = F.aggregate("ops", F.lit(0).cast("long"), lambda a, o: a + packed(o))
    return batches.select("base", F.size("ops").alias("ops"), puts.alias("puts"), (F.size("ops") - puts).alias("deletes"), size.alias("packed_bytes"))
