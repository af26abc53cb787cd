"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.db import Database
from kvlake.functions import bloom, codec
from kvlake.operators import batch, read, resolve
from kvlake.operators.batch import WriteBatch
from kvlake.plans import compaction, manifest
from kvlake.schema import Options, ReadOptions, WriteOptions
from kvlake.sources.workspace import Workspace
from kvlake.streaming import tail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

START, END, SNAPSHOT = "user00000002", "user00000012", 700
_RUN_ROWS = 100


def query(sql: str | None):
    """Register a function under its name, with its SQL; ``{log}`` etc. are filled in."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _CTES + sql
        return f

    return register


_CTES = """
WITH log AS (
  SELECT 'user' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_id AS sequence,
         CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS value_type,
         CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value
  FROM events),
latest AS (
  SELECT key, sequence, value_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS rn FROM log) WHERE rn = 1),
live AS (SELECT * FROM latest WHERE value_type = 1),
old AS (
  SELECT key, sequence, value_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS rn FROM log WHERE sequence <= 700) WHERE rn = 1),
runs AS (
  SELECT CASE WHEN file_number % 7 < 2 THEN 0 ELSE 1 + file_number % 3 END AS level, * FROM (
    SELECT sequence // 100 AS file_number, min(key) AS min_key, max(key) AS max_key, count(*) AS entry_count,
           CAST(sum(strlen(key) + 9 + coalesce(strlen(value), 0)) AS BIGINT) AS file_size,
           min(sequence) AS min_seq, max(sequence) AS max_seq
    FROM log GROUP BY 1))
"""


def _key(column: str, prefix: str = "user", width: int = 8) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), width, "0"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: errors delete their user's key, others set it."""
    error = F.col("event_type") == "error"
    return _read(spark, sf_dir, "events").select(
        _key("user_id").alias("key"), F.col("event_id").alias("sequence"), F.when(error, 0).otherwise(1).alias("value_type"), F.when(~error, F.col("props")).alias("value")
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a hundred events, dealt to levels by their number."""
    log = event_log(spark, sf_dir).withColumn("file_number", F.floor(F.col("sequence") / _RUN_ROWS).cast("long"))
    runs = manifest.run_stats(log, "file_number")
    return runs.withColumn("level", F.when(F.col("file_number") % 7 < 2, 0).otherwise(1 + F.col("file_number") % 3).cast("long"))


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write batch of each hundred events: ``(base, ops)``."""
    op = F.struct("sequence", F.when(F.col("value_type") == 1, 1).otherwise(2).alias("op"), "key", "value")
    rows = event_log(spark, sf_dir).withColumn("base", F.floor(F.col("sequence") / _RUN_ROWS).cast("long") * _RUN_ROWS)
    ops = F.transform(F.sort_array(F.collect_list(op)), lambda o: F.struct(o["op"].alias("op"), o["key"].alias("key"), o["value"].alias("value")))
    return rows.groupBy("base").agg(ops.alias("ops"))


def _kv(df: DataFrame) -> DataFrame:
    return df.select("key", "value")


# ------------------------------------------------------------------ reads


@query("SELECT key, value FROM live")
def kv_live(spark, sf_dir):
    return _kv(resolve.live(event_log(spark, sf_dir)))


@query("SELECT key, value FROM live WHERE key = 'user00000003'")
def kv_get_hit(spark, sf_dir):
    return read.get(event_log(spark, sf_dir), "user00000003")


@query("SELECT key, value FROM live WHERE key = 'user99999999'")
def kv_get_missing(spark, sf_dir):
    return read.get(event_log(spark, sf_dir), "user99999999")


@query("SELECT key, value FROM live WHERE key = (SELECT min(key) FROM latest WHERE value_type = 0)")
def kv_get_deleted(spark, sf_dir):
    log = event_log(spark, sf_dir)
    first = resolve.tombstones(log).agg(F.min("key").alias("key"))
    return _kv(resolve.live(log.join(first, "key", "left_semi")))


@query("SELECT key, value FROM old WHERE value_type = 1 AND key = 'user00000003'")
def kv_get_snapshot(spark, sf_dir):
    return read.get(event_log(spark, sf_dir), "user00000003", SNAPSHOT)


@query("""SELECT k.key, live.value, live.key IS NOT NULL AS found
FROM (SELECT DISTINCT 'user' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer) k LEFT JOIN live ON k.key = live.key""")
def kv_multi_get(spark, sf_dir):
    keys = _read(spark, sf_dir, "customer").select(_key("c_custkey").alias("key"))
    return read.multi_get(event_log(spark, sf_dir), keys)


@query("""SELECT k.key, CASE WHEN latest.key IS NULL THEN 'not_found' WHEN value_type = 1 THEN 'found' ELSE 'deleted' END AS status
FROM (SELECT DISTINCT 'user' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer) k LEFT JOIN latest ON k.key = latest.key""")
def kv_lookup_status(spark, sf_dir):
    keys = _read(spark, sf_dir, "customer").select(_key("c_custkey").alias("key"))
    return read.lookup_status(event_log(spark, sf_dir), keys)


@query("SELECT key, value FROM live WHERE key >= 'user00000002' AND key < 'user00000012' ORDER BY key")
def kv_scan(spark, sf_dir):
    return read.scan(event_log(spark, sf_dir), START, END)


@query("SELECT key, value FROM live WHERE key >= 'user00000002' AND key < 'user00000012' ORDER BY key LIMIT 5")
def kv_scan_limit(spark, sf_dir):
    return read.scan(event_log(spark, sf_dir), START, END, 5)


@query("SELECT key, value FROM live WHERE key >= 'user00000012' AND key < 'user00000002'")
def kv_scan_empty(spark, sf_dir):
    return read.scan(event_log(spark, sf_dir), END, START)


@query("SELECT key, value FROM live LIMIT 0")
def kv_scan_limit0(spark, sf_dir):
    return read.scan(event_log(spark, sf_dir), START, END, 0)


@query("SELECT key, value FROM old WHERE value_type = 1 AND key >= 'user00000002' AND key < 'user00000012' ORDER BY key LIMIT 8")
def kv_scan_snapshot(spark, sf_dir):
    return read.scan(event_log(spark, sf_dir), START, END, 8, SNAPSHOT)


@query("""SELECT key, value FROM (
  SELECT 'user' || CAST(user_id AS VARCHAR) AS key, props AS value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
WHERE rn = 1 AND event_type <> 'error' AND key >= 'user1' AND key < 'user12' ORDER BY key""")
def kv_scan_prefix_keys(spark, sf_dir):
    short = F.concat(F.lit("user"), F.substring("key", 5, 8).cast("int").cast("string"))
    return read.scan(event_log(spark, sf_dir).withColumn("key", short), "user1", "user12")


@query("SELECT key, sequence FROM latest WHERE value_type = 0")
def kv_tombstones(spark, sf_dir):
    return resolve.tombstones(event_log(spark, sf_dir)).select("key", "sequence")


@query("SELECT key, sequence, value_type, value FROM log ORDER BY key, sequence DESC")
def kv_history(spark, sf_dir):
    return resolve.history(event_log(spark, sf_dir))


# ------------------------------------------------------------------ merges


@query("SELECT key, value FROM live")
def kv_merge_sources(spark, sf_dir):
    log = event_log(spark, sf_dir)
    slices = [log.where(F.col("sequence") % 3 == i) for i in range(3)]
    return _kv(resolve.live(resolve.merge_sources(slices)))


_ORDERS = """, base AS (SELECT 'order' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderkey AS sequence, o_orderstatus AS value FROM orders)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(
        _key("o_orderkey", "order", 10).alias("key"), F.col("o_orderkey").alias("sequence"), F.lit(1).alias("value_type"), F.col("o_orderstatus").alias("value")
    )


@query(_ORDERS + " SELECT key, CASE WHEN sequence % 10 = 3 THEN 'new_' || value ELSE value END AS value FROM base")
def kv_merge_updates(spark, sf_dir):
    base = _orders(spark, sf_dir)
    above = base.where("sequence % 10 = 3").select("key", (F.col("sequence") + (1 << 40)).alias("sequence"), "value_type", F.concat(F.lit("new_"), "value").alias("value"))
    return _kv(resolve.live(resolve.merge_sources([base, above])))


@query(_ORDERS + " SELECT key, value FROM base WHERE sequence % 10 <> 4")
def kv_merge_deletes(spark, sf_dir):
    base = _orders(spark, sf_dir)
    above = base.where("sequence % 10 = 4").select("key", (F.col("sequence") + (1 << 40)).alias("sequence"), F.lit(0).alias("value_type"), F.lit(None).cast("string").alias("value"))
    return _kv(resolve.live(resolve.merge_sources([base, above])))


# ----------------------------------------------------------------- batches


@query("SELECT key, sequence, value FROM live")
def kv_batch_apply(spark, sf_dir):
    return resolve.live(batch.expand_batches(event_batches(spark, sf_dir))).select("key", "sequence", "value")


@query("""SELECT sequence // 100 * 100 AS base, count(*) AS ops, CAST(sum(value_type) AS BIGINT) AS puts, CAST(sum(1 - value_type) AS BIGINT) AS deletes,
CAST(sum(5 + strlen(key) + CASE WHEN value_type = 1 THEN 4 + strlen(value) ELSE 0 END) AS BIGINT) AS packed_bytes FROM log GROUP BY 1""")
def kv_batch_stats(spark, sf_dir):
    stats = batch.batch_stats(event_batches(spark, sf_dir))
    return stats.select("base", *[F.col(c).cast("long").alias(c) for c in ("ops", "puts", "deletes")], "packed_bytes")


@query("SELECT sequence // 256 AS batch, count(*) AS requests, max(value_type) = 1 AS needs_sync, min(sequence) AS first_sequence FROM log GROUP BY 1")
def kv_group_commit(spark, sf_dir):
    return tail.group_commits(event_log(spark, sf_dir).withColumn("needs_sync", F.col("value_type") == 1))


@query("SELECT key, value FROM live")
def kv_wal_replay(spark, sf_dir):
    return _kv(resolve.live(batch.expand_batches(event_batches(spark, sf_dir))))


@query("""SELECT sequence // 1000 AS file_number, key, sequence FROM log
WHERE sequence % 977 <> 500 AND sequence < coalesce((SELECT min(b.sequence) FROM log b WHERE b.sequence // 1000 = log.sequence // 1000 AND b.sequence % 977 = 500), 9223372036854775807)""")
def kv_wal_truncate(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("file_number").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = event_log(spark, sf_dir).withColumn("file_number", F.floor(F.col("sequence") / 1000).cast("long"))
    bad = log.withColumn("bad", F.max((F.col("sequence") % 977 == 500).cast("int")).over(order))
    return bad.where("bad = 0").select("file_number", "key", "sequence")


# ------------------------------------------------------- runs and manifest


@query("SELECT file_number, min_key, max_key, entry_count, file_size, min_seq, max_seq FROM runs")
def kv_flush_runs(spark, sf_dir):
    return event_runs(spark, sf_dir).drop("level")


@query("SELECT level, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM runs GROUP BY level")
def kv_level_stats(spark, sf_dir):
    return manifest.level_stats(event_runs(spark, sf_dir))


@query("""SELECT file_number, file_size, min_key, max_key FROM runs
WHERE NOT (file_number % 4 IN (0, 1) AND file_number // 4 * 4 + 3 <= (SELECT max(file_number) FROM runs))""")
def kv_manifest_fold(spark, sf_dir):
    number = F.col("file_number")
    added = F.array(F.struct(F.lit(0).alias("level"), "file_number", "file_size", "min_key", "max_key"))
    gone = F.when(number % 4 == 3, F.array(*[F.struct(F.lit(0).alias("level"), (number - i).alias("file_number")) for i in (3, 2)]))
    edits = event_runs(spark, sf_dir).select(number.alias("edit_id"), added.alias("new_files"), gone.alias("deleted_files"))
    return manifest.fold_edits(edits).select("file_number", "file_size", "min_key", "max_key")


@query("SELECT count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM runs")
def kv_manifest_snapshot(spark, sf_dir):
    edit = manifest.snapshot_edit(event_runs(spark, sf_dir).select("level", "file_number", "file_size"))
    return edit.select(F.size("new_files").cast("long").alias("files"), F.aggregate("new_files", F.lit(0).cast("long"), lambda a, f: a + f["file_size"]).alias("bytes"))


@query("SELECT file_number FROM runs WHERE min_key <= 'user00000003' AND max_key >= 'user00000003'")
def kv_file_prune_point(spark, sf_dir):
    return manifest.may_hold(event_runs(spark, sf_dir), "user00000003").select("file_number")


@query("SELECT file_number FROM runs WHERE min_key < 'user00000001' AND max_key >= 'user00000000'")
def kv_file_prune_range(spark, sf_dir):
    return manifest.overlapping(event_runs(spark, sf_dir), "user00000000", "user00000001").select("file_number")


_BLOCKS = """, placed AS (
  SELECT sequence // 1000 AS file_number, key, CAST((row_number() OVER (PARTITION BY sequence // 1000 ORDER BY key, sequence DESC) - 1) // 16 AS INTEGER) AS block FROM log),
blocks AS (SELECT file_number, block, max(key) AS last_key, count(*) AS entries FROM placed GROUP BY ALL)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn("file_number", F.floor(F.col("sequence") / 1000).cast("long"))
    return manifest.block_index(log, 16, Workspace(spark, "blocks"))


@query(_BLOCKS + " SELECT * FROM blocks")
def kv_block_index(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(_BLOCKS + """, probes AS (
  SELECT sequence // 1000 AS file_number, key FROM log UNION SELECT sequence // 1000 + 1, key FROM log),
ends AS (SELECT file_number, last_key, min(block) AS block FROM blocks GROUP BY ALL),
tops AS (SELECT file_number, max(block) AS top FROM blocks GROUP BY ALL),
asked AS (SELECT p.file_number, t.top, p.key FROM probes p JOIN tops t ON p.file_number = t.file_number)
SELECT a.file_number, a.key, coalesce(e.block, a.top) AS block
FROM asked a ASOF LEFT JOIN ends e ON a.file_number = e.file_number AND a.key <= e.last_key""")
def kv_find_block(spark, sf_dir):
    """Every key of a run is looked up in that run, where it is, and in the next one, where it may not be."""
    own = event_log(spark, sf_dir).select(F.floor(F.col("sequence") / 1000).cast("long").alias("file_number"), "key")
    probes = own.unionByName(own.withColumn("file_number", F.col("file_number") + 1)).distinct()
    return manifest.find_block(_blocks(spark, sf_dir), probes)


# -------------------------------------------------------------- compaction

_SMALL = Options(base_level_size=20_000)


@query(""", due AS (
  SELECT level FROM (SELECT level, count(*) AS files, sum(file_size) AS bytes FROM runs GROUP BY level)
  WHERE CASE WHEN level = 0 THEN files >= 4 ELSE level < 6 AND bytes > 20000 * power(10, level - 1) END ORDER BY level LIMIT 1),
held AS (SELECT runs.*, row_number() OVER (ORDER BY min_key, file_number) AS place FROM runs JOIN due ON runs.level = due.level),
chosen AS (SELECT * FROM held WHERE level = 0 OR place = 1),
span AS (SELECT level, count(*) AS n, min(min_key) AS low, max(max_key) AS high FROM chosen GROUP BY level)
SELECT s.level, s.level + 1 AS output_level, s.n + (SELECT count(*) FROM runs r WHERE r.level = s.level + 1 AND r.min_key <= s.high AND r.max_key >= s.low) AS inputs
FROM span s""")
def kv_pick_compaction(spark, sf_dir):
    return compaction.pick_from_files(event_runs(spark, sf_dir), _SMALL)


@query("""SELECT max(CASE WHEN level = 0 THEN files >= 4 ELSE level < 6 AND bytes > 20000 * power(10, level - 1) END) AS due
FROM (SELECT level, count(*) AS files, sum(file_size) AS bytes FROM runs GROUP BY level)""")
def kv_needs_compaction(spark, sf_dir):
    return compaction.pick_from_files(event_runs(spark, sf_dir), _SMALL).agg((F.count("*") > 0).alias("due"))


@query("""SELECT l0_runs, CASE WHEN l0_runs >= 12 THEN 'STOP' WHEN l0_runs >= 8 THEN 'SLOW' ELSE 'OK' END AS status
FROM (SELECT count(*) AS l0_runs FROM runs WHERE level = 0)""")
def kv_write_stall(spark, sf_dir):
    runs = event_runs(spark, sf_dir).where("level = 0").agg(F.count("*").alias("l0_runs"))
    return runs.select("l0_runs", compaction.stall_status(F.col("l0_runs"), Options()).alias("status"))


@query("SELECT key, sequence, value_type, value FROM live")
def kv_compact_full(spark, sf_dir):
    return compaction.rewrite(event_log(spark, sf_dir), drop_tombstones=True)


_UPPER = """, upper_rows AS (
  SELECT key, sequence, value_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS rn FROM log WHERE sequence // 100 % 7 < 2) WHERE rn = 1)"""


@query(_UPPER + " SELECT * FROM upper_rows")
def kv_compact_partial(spark, sf_dir):
    level0 = event_log(spark, sf_dir).where("floor(sequence / 100) % 7 < 2")
    return compaction.rewrite(level0, drop_tombstones=False)


@query("""SELECT key, sequence, value_type, value FROM log WHERE sequence > 700
UNION ALL SELECT * FROM old WHERE value_type = 1""")
def kv_compact_retained(spark, sf_dir):
    return compaction.rewrite(event_log(spark, sf_dir), drop_tombstones=True, snapshot=SNAPSHOT)


@query("SELECT key, value FROM live WHERE false")
def kv_compact_invariant(spark, sf_dir):
    log = event_log(spark, sf_dir)
    level0 = F.expr("floor(sequence / 100) % 7 < 2")
    after = _kv(resolve.live(resolve.merge_sources([compaction.rewrite(log.where(level0), drop_tombstones=False), log.where(~level0)])))
    before = _kv(resolve.live(log))
    return before.exceptAll(after).unionByName(after.exceptAll(before))


# ------------------------------------------------------------------ codecs


@query("""SELECT key, position, shared, block FROM (
  SELECT block, key, CAST(rn - 1 AS INTEGER) AS position,
         CAST(CASE WHEN (rn - 1) % 16 = 0 THEN 0 ELSE len(list_filter(range(1, least(length(key), length(before)) + 1), lambda i: left(key, i) = left(before, i))) END AS INTEGER) AS shared
  FROM (SELECT block, key, row_number() OVER w AS rn, lag(key) OVER w AS before
        FROM (SELECT CAST(substr(key, 5) AS BIGINT) // 64 AS block, key FROM latest) WINDOW w AS (PARTITION BY block ORDER BY key)))""")
def kv_shared_prefix(spark, sf_dir):
    keys = event_log(spark, sf_dir).select("key").distinct()
    block = F.floor(F.substring("key", 5, 8).cast("long") / 64).cast("long")
    return codec.block_prefixes(keys.select(block.alias("block"), "key"))


@query("""SELECT key, sequence, hex(key) || lpad(hex(CAST(18446744073709551615 - sequence AS UBIGINT)), 16, '0') || '0' || CAST(value_type AS VARCHAR) AS encoded FROM log""")
def kv_key_codec(spark, sf_dir):
    encoded = codec.internal_key(F.col("key"), F.col("sequence"), F.col("value_type").cast("long"))
    return event_log(spark, sf_dir).select("key", "sequence", F.hex(encoded).alias("encoded"))


@query("""SELECT sequence, list_aggregate(list_transform(range(CAST((length(bin(n)) + 6) // 7 AS BIGINT)), lambda i:
    printf('%02X', CAST((n >> CAST(7 * i AS BIGINT) & 127) + CASE WHEN i + 1 < (length(bin(n)) + 6) // 7 THEN 128 ELSE 0 END AS BIGINT))), 'string_agg', '') AS encoded
FROM (SELECT sequence, CAST(sequence * sequence * 7919 AS BIGINT) AS n FROM log)""")
def kv_varint(spark, sf_dir):
    log = event_log(spark, sf_dir).select("sequence", (F.col("sequence") * F.col("sequence") * 7919).alias("n"))
    return log.select("sequence", codec.varint(F.col("n")).alias("encoded"))


# CRC-32 bit by bit: the register is moved by each bit of the text, lowest first.
@query("""SELECT key, sequence, CAST(xor(list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(8 * strlen(value)), lambda i: CAST(ascii(substr(value, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT) >> CAST(i % 8 AS BIGINT) & 1)),
    lambda c, b: xor(c >> 1, CASE WHEN c & 1 <> b THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)), CAST(4294967295 AS BIGINT)) AS BIGINT) AS crc
FROM log WHERE value_type = 1""")
def kv_crc(spark, sf_dir):
    return event_log(spark, sf_dir).where("value_type = 1").select("key", "sequence", F.crc32("value").alias("crc"))


@query("""SELECT count(DISTINCT key) AS present, CAST(0 AS BIGINT) AS missed, (SELECT count(*) FROM customer) AS absent, true AS within_rate FROM log""")
def kv_bloom(spark, sf_dir):
    """No key is missed, and at most 3 in 100 absent ones pass (10 bits a key: about 0.8 in 100)."""
    keys = event_log(spark, sf_dir).select("key").distinct()
    filled = bloom.build_bloom(keys, keys.count())
    other = _read(spark, sf_dir, "customer").select(_key("c_custkey", "cust").alias("key"), F.lit(False).alias("there"))
    answers = bloom.probe_bloom(keys.withColumn("there", F.lit(True)).unionByName(other), filled)
    passed = F.count_if(~F.col("there") & F.col("maybe"))
    return answers.agg(
        F.count_if("there").alias("present"), F.count_if(F.col("there") & ~F.col("maybe")).alias("missed"), F.count_if(~F.col("there")).alias("absent"),
        (passed <= F.greatest(F.lit(3), 0.03 * F.count_if(~F.col("there")))).alias("within_rate"),
    )


# ---------------------------------------------------------------- the table


def _filled(spark: SparkSession, sf_dir: str, options: Options, slices: int = 4) -> tuple[Database, list[int]]:
    """A new table that holds the events, written in slices, and the sequence after each."""
    db = Database.open(spark, Workspace(spark, "table").path, options)
    log, seen = event_log(spark, sf_dir), []
    count = log.count()
    part = F.floor(F.col("sequence") * slices / count)
    op = F.when(F.col("value_type") == 1, 1).otherwise(2).alias("op")
    for i in range(slices):
        db.write_frame(log.where(part == i).select(op, "key", "value", (F.col("sequence") - (count * i + slices - 1) // slices).alias("n")), "n")
        seen.append(db.last_sequence)
    return db, seen


def _text(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


_TABLE = Options(l0_compaction_trigger=4, l0_slowdown_trigger=100, l0_stop_trigger=100, base_level_size=20_000, checkpoint_edits=3)


@query("SELECT key, value FROM live")
def kv_table_reopened(spark, sf_dir):
    """Written as one batch, reopened, read."""
    db, _ = _filled(spark, sf_dir, _TABLE, 1)
    db.close()
    return _text(Database.open(spark, db.folder.path, _TABLE).live())


@query("SELECT key, value FROM live")
def kv_table_compacted(spark, sf_dir):
    """Written in slices, compacted until nothing is due, reopened from a checkpointed manifest, read."""
    db, _ = _filled(spark, sf_dir, _TABLE, 6)
    while db.compact():
        pass
    db.close()
    return _text(Database.open(spark, db.folder.path, _TABLE).live())


@query("""SELECT CAST(0 AS INTEGER) AS level, count(*) AS entry_count, CAST(sum(strlen(key) + 9 + coalesce(strlen(value), 0)) AS BIGINT) AS file_size, min(key) AS min_key, max(key) AS max_key
FROM log GROUP BY sequence * 4 // (SELECT count(*) FROM log)""")
def kv_table_runs(spark, sf_dir):
    db, _ = _filled(spark, sf_dir, _TABLE)
    return db.files_frame().select("level", "entry_count", "file_size", F.col("min_key").cast("string").alias("min_key"), F.col("max_key").cast("string").alias("max_key"))


@query("""SELECT key, value FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence DESC) AS rn FROM log WHERE sequence * 4 // (SELECT count(*) FROM log) < 2)
WHERE rn = 1 AND value_type = 1""")
def kv_table_snapshot(spark, sf_dir):
    """Read at the sequence of the second slice, which is retained through a compaction."""
    db, seen = _filled(spark, sf_dir, _TABLE)
    db.snapshots.append(seen[1])
    db.compact()
    return _text(db.live(ReadOptions(snapshot=seen[1])))


@query("SELECT key, value FROM live WHERE key >= 'user00000002' AND key < 'user00000012' ORDER BY key LIMIT 5")
def kv_table_scan(spark, sf_dir):
    return _text(_filled(spark, sf_dir, _TABLE.but(block_cache_size=8 << 20))[0].scan(START, END, 5))


@query("""SELECT k.key, live.value, live.key IS NOT NULL AS found
FROM (SELECT DISTINCT 'user' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer) k LEFT JOIN live ON k.key = live.key""")
def kv_table_multi_get(spark, sf_dir):
    keys = _read(spark, sf_dir, "customer").select(_key("c_custkey").cast("binary").alias("key"))
    found = _filled(spark, sf_dir, _TABLE)[0].multi_get(keys)
    return found.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "found")


@query("SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS key, n_name AS value FROM nation WHERE n_regionkey <> 0")
def kv_table_log_replay(spark, sf_dir):
    """Single puts and deletes, some not synced, never flushed: reopening replays the log."""
    db = Database.open(spark, Workspace(spark, "table").path)
    nations = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()  # 25 rows at any scale
    for r in nations:
        db.put(f"n{r.n_nationkey:03d}", r.n_name, WriteOptions(sync=r.n_nationkey % 5 == 0))
    for r in nations:
        if r.n_regionkey == 0:
            db.delete(f"n{r.n_nationkey:03d}", WriteOptions(sync=False))
    db.close()
    return _text(Database.open(spark, db.folder.path).live())


@query("SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS key, r_name AS value FROM region")
def kv_table_group_commit(spark, sf_dir):
    """Batches of a shared writer, then a flush and a reopening."""
    db = Database.open(spark, Workspace(spark, "table").path)
    writer = db.group_commit()
    regions = _read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()  # 5 rows at any scale
    waits = [writer.submit(WriteBatch().put(f"r{r.r_regionkey}", "old").put(f"gone{r.r_regionkey}", "x")) for r in regions]
    waits += [writer.submit(WriteBatch().put(f"r{r.r_regionkey}", r.r_name).delete(f"gone{r.r_regionkey}")) for r in regions]
    writer.close()
    assert [w.result() for w in waits] == [2 * i + 2 for i in range(len(waits))]
    db.flush()
    return _text(Database.open(spark, db.folder.path).live())


@query("SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS key, n_name AS value FROM nation WHERE n_nationkey < 10")
def kv_table_torn_log(spark, sf_dir):
    """A damaged record cuts the log: what was logged before it is there, the rest is not."""
    db = Database.open(spark, Workspace(spark, "table").path)
    for r in _read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name").collect():  # 25 rows at any scale
        db.put(f"n{r.n_nationkey:03d}", r.n_name)
    db.folder.write(f"wal/{11:012d}.rec", b"00000000 torn", replace=True)
    return _text(Database.open(spark, db.folder.path).live())


@query("SELECT CAST(0 AS INTEGER) AS level, count(*) AS runs, count(*) AS entries, min(n_nationkey) + 1 AS min_seq, max(n_nationkey) + 1 AS max_seq FROM nation")
def kv_table_flush_trigger(spark, sf_dir):
    """A buffer of one byte is full after each put: a run each, sequences without gaps."""
    db = Database.open(spark, Workspace(spark, "table").path, Options(memtable_size=1, l0_slowdown_trigger=100, l0_stop_trigger=100))
    for r in _read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name").collect():  # 25 rows at any scale
        db.put(f"n{r.n_nationkey:03d}", r.n_name)
    runs = Database.open(spark, db.folder.path).files_frame()
    return runs.groupBy("level").agg(F.count("*").alias("runs"), F.sum("entry_count").alias("entries"), F.min("min_seq").alias("min_seq"), F.max("max_seq").alias("max_seq"))
