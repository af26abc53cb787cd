"""Exact duplicates through a log-structured merge index of digests.

Digests are dealt to memtables of a bounded number of rows by a hash of their
id.  Each memtable is flushed as a run: digests in order, each with the smallest
id and the number of rows.  Tiered compaction merges a fixed number of runs to
one run of the next tier, keeping the smallest id of each digest, until one run
is left.  Runs have two filters: Parquet bloom filters on the digest, which
``point_lookup`` reads, and a bitmap of a fixed size, which ``lookup`` sends to
all tasks.  A hit in the index counts only once the bytes were compared.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.storage import Scratch, unused

#: Bits of the bitmap filter: 2,048 bitmaps of 4 KiB, at most 8 MiB in all.
FILTER_BITS = 1 << 26
#: Rows of a memtable, on average, and runs that one compaction merges.
MEMTABLE_ROWS, FAN_IN = 1 << 20, 8
#: A bloom filter on the digest in each file, sized by what the file holds.
_FILTERED = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": "262144"}


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body.cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, raw, digest)`` of every row: a hash of the text as it is, and the SHA-256 of the normalised text."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("raw"), _digest(normalised(text)).alias("digest"))


def flush_runs(rows: DataFrame, memtables: int, scratch: Scratch, name: str = "tier0") -> DataFrame:
    """Write one sorted run ``(digest, low, n)`` per memtable, with filters.

    Rows of one digest are summed up before they move, so a digest that a third
    of the rows share sends one row per task and run.
    """
    filed = rows.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int"))
    runs = filed.groupBy("run", "digest").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    return scratch.table(runs.sortWithinPartitions("run", "digest"), name, ("run",), **_FILTERED)


def merge_runs(runs: DataFrame, fan_in: int, scratch: Scratch, name: str) -> DataFrame:
    """One compaction: each ``fan_in`` neighbouring runs become a run of the next tier."""
    merged = runs.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), "digest").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    return scratch.table(merged.sortWithinPartitions("run", "digest"), name, ("run",), **_FILTERED)


def compact(runs: DataFrame, scratch: Scratch, fan_in: int = FAN_IN) -> DataFrame:
    """Tiers of compactions until one run is left: ``(digest, low, n)``."""
    tier, count = 0, (runs.agg(F.max("run")).first()[0] or 0) + 1
    while count > 1:
        tier, count = tier + 1, -(-count // fan_in)
        runs = merge_runs(runs, fan_in, scratch, f"tier{tier}")
        if tier > 1:
            scratch.remove(f"tier{tier - 1}")
    return runs.select("digest", "low", "n")


def build_index(rows: DataFrame, scratch: Scratch, memtable_rows: int = MEMTABLE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Index ``(digest, low, n)`` of ``rows(id, digest)``: flushed memtables, compacted."""
    memtables = max(1, -(-rows.count() // memtable_rows))
    return compact(flush_runs(rows, memtables, scratch), scratch, fan_in)


def _position(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, key: str, scratch: Scratch, name: str = "filter") -> DataFrame:
    """Bitmap filter ``(bucket, bits)`` of a column of keys; its size has a fixed bound."""
    at = keys.select(_position(F.col(key)).alias("at"))
    built = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    return scratch.table(built, name)


def flagged(rows: DataFrame, key: str, bitmaps: DataFrame, flag: str) -> DataFrame:
    """``rows`` and whether the filter has their key set: always for keys in it, seldom for others."""
    at = _position(F.col(key))
    bucket, place, held, bits = unused(rows, "bucket", "place", "held", "bits")
    marked = rows.withColumn(bucket, F.bitmap_bucket_number(at)).withColumn(place, F.bitmap_bit_position(at))
    marked = marked.join(F.broadcast(bitmaps.select(F.col("bucket").alias(held), F.col("bits").alias(bits))), F.col(bucket) == F.col(held), "left")
    byte = f"cast(conv(hex(substring({bits}, cast({place} div 8 as int) + 1, 1)), 16, 10) as int)"
    return marked.select(*rows.columns, F.expr(f"coalesce(shiftright({byte}, cast({place} % 8 as int)) & 1, 0) = 1").alias(flag))


def may_hold(rows: DataFrame, key: str, bitmaps: DataFrame) -> DataFrame:
    """Rows whose key is set in the filter, and some whose is not."""
    (flag,) = unused(rows, "flag")
    return flagged(rows, key, bitmaps, flag).where(F.col(flag)).drop(flag)


def lookup(index: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(digest, ...)`` that the index holds, with ``low`` and ``n``; the filter goes first."""
    return may_hold(rows, "digest", key_filter(index, "digest", scratch, "lookup")).join(index, "digest")


def point_lookup(index: DataFrame, digest: bytes) -> DataFrame:
    """The index row of one digest; files whose bloom filter lacks it are not read."""
    return index.where(F.col("digest") == F.lit(bytearray(digest)))


def _indexed(docs: DataFrame, id_col: str, text_col: str, memtable_rows: int, fan_in: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests of all rows, their index, and a filter of the raw hashes of texts that others equal."""
    rows = scratch.table(digests(docs, id_col, text_col), "digests")
    index = build_index(rows.select("id", "digest"), scratch, memtable_rows, fan_in)
    hits = lookup(index.where("n > 1").select("digest"), rows.select("raw", "digest"), scratch)
    return rows, index, key_filter(hits.select("raw").distinct(), "raw", scratch, "suspects")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = MEMTABLE_ROWS, fan_in: int = FAN_IN
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Equal means the same bytes after every run of ``[\\x20\\x09-\\x0D]`` became one
    space; null equals the empty text.  The smallest id of a group stays.  Rows
    that repeat an id with an equal text all count in ``group_size``, and all of
    them are marked kept.  A null id is never the smallest unless all ids of a
    group are null; then ``keep_id`` is null and all its rows are kept.  Other
    columns are ignored; an empty table gives an empty result.

    Digests are computed once.  To compare bytes, texts are read again, but only
    those are normalised whose raw hash a shared digest has.
    """
    scratch = Scratch(docs.sparkSession, "exactdedup")
    rows, index, suspects = _indexed(docs, id_col, text_col, memtable_rows, fan_in, scratch)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id")).withColumn("raw", F.xxhash64("text"))
    bodies = may_hold(texts, "raw", suspects).select("id", normalised(F.col("text")).alias("body"))
    bodies = bodies.select("id", "body", _digest(F.col("body")).alias("digest"))
    # Byte verification: a group whose smallest and largest texts agree is one text.
    # A text that is here by a false positive of the filter is a group of its own.
    broken = bodies.groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("digest")
    broken = scratch.table(broken, "broken")
    same = rows.join(index, "digest").select("id", "digest", F.col("low").alias("keep_id"), F.col("n").alias("group_size"))
    if broken.isEmpty():
        out = same
    else:  # two texts under one digest: such groups are formed by their bytes
        apart = bodies.join(broken, "digest")
        groups = apart.groupBy("digest", "body").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        out = same.join(broken, "digest", "left_anti").unionByName(apart.join(groups, ["digest", "body"]).drop("body"))
    return out.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = MEMTABLE_ROWS, fan_in: int = FAN_IN
) -> DataFrame:
    """Of equal texts, one row with the smallest id; all columns of ``docs``.

    Equality and null texts are those of ``exact_duplicates``.  Rows that share
    the smallest id, or are all without one, are tied: of these the row whose
    columns are the smallest stays, one by one in their order.  Columns must be
    of types that can be ordered.  An empty table gives an empty result.

    Rows whose text no other row equals, by the index, go through as they are;
    the others are grouped by their bytes, and a task sends one row a group.
    """
    scratch = Scratch(docs.sparkSession, "exactcopies")
    suspects = _indexed(docs, id_col, text_col, memtable_rows, fan_in, scratch)[2]
    raw, flag = unused(docs, "raw", "flag")
    marked = flagged(docs.withColumn(raw, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), raw, suspects, flag).drop(raw)
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.struct(*docs.columns).alias("row"))).alias("first")
    kept = marked.where(F.col(flag)).groupBy(normalised(F.col(text_col)).alias("body")).agg(first).select("first.row.*")
    return marked.where(~F.col(flag)).drop(flag).unionByName(kept)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
