"""Schemas, constants, options and errors of the versioned key-value table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql.types import ArrayType, BinaryType, ByteType, LongType, StructField, StructType

DELETION, VALUE = 0, 1
OP_PUT, OP_DELETE = 1, 2
MAX_SEQUENCE = (1 << 63) - 1
#: Bytes that the sequence and type add to a key in its encoded form.
TRAILER_BYTES = 9

LOG_SCHEMA = StructType(
    [
        StructField("key", BinaryType(), False),
        StructField("sequence", LongType(), False),
        StructField("value_type", ByteType(), False),
        StructField("value", BinaryType(), True),
    ]
)
OPS_SCHEMA = ArrayType(StructType([StructField("op", ByteType()), StructField("key", BinaryType()), StructField("value", BinaryType())]))
FILE_COLUMNS = ("level", "file_number", "file_size", "entry_count", "min_key", "max_key", "min_seq", "max_seq")


class KvError(Exception):
    """Base of all errors of the table."""


class Corruption(KvError):
    """A stored record does not have its checksum or form."""


class WriteStall(KvError):
    """Too many level-0 runs: compact before writing on."""


class InvalidArgument(KvError, ValueError):
    """A key, value or option that cannot be used."""


@dataclass(frozen=True)
class Options:
    """Policy of one table; sizes are in bytes."""

    memtable_size: int = 4 << 20
    l0_compaction_trigger: int = 4
    l0_slowdown_trigger: int = 8
    l0_stop_trigger: int = 12
    level_size_multiplier: int = 10
    base_level_size: int = 10 << 20
    max_levels: int = 7
    sync_writes: bool = True
    bloom_filters: bool = True
    #: Bits of a run's bloom filter per key; its rate of false positives follows.
    bloom_bits_per_key: int = 10
    #: Bytes of a data page, the unit that a lookup reads.
    block_size: int = 4 << 10
    #: Bytes of entries of runs that reads keep in executor memory; 0: none.
    block_cache_size: int = 0
    #: Manifest edits after which all live files are written as one edit.
    checkpoint_edits: int = 64
    write_stall_delay: float = 0.001
    #: Rows that one output file of a run aims at; files are cut by key range.
    rows_per_file: int = 5_000_000

    def but(self, **changes) -> Options:
        return replace(self, **changes)


@dataclass(frozen=True)
class WriteOptions:
    """``sync``: log the write before it returns; else with the next synced one."""

    sync: bool = True


@dataclass(frozen=True)
class ReadOptions:
    """``snapshot``: read as of this sequence; None: of the last committed one."""

    snapshot: int | None = None
