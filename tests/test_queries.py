"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from kvlake.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer orders part events nation region".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.count() > 0
        return
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, cursor.fetchall()))


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bloom_has_no_false_negative(spark):
    row = QUERIES["kv_bloom"](spark, SF).first()
    assert row.missed == 0 and row.present > 0 and row.absent > 0 and row.within_rate


def test_crc_matches_zlib(spark):
    import zlib

    from kvlake.queries import event_log

    values = {(r.key, r.sequence): r.value for r in event_log(spark, SF).where("value_type = 1").collect()}
    assert {(r.key, r.sequence): r.crc for r in QUERIES["kv_crc"](spark, SF).collect()} == {k: zlib.crc32(v.encode()) for k, v in values.items()}


def test_point_get_plans_without_a_shuffle_and_pushes_its_filter(spark):
    plan = QUERIES["kv_get_hit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrderedAndProject" in plan


def test_resolver_limits_before_the_shuffle(spark):
    plan = QUERIES["kv_live"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1


def test_find_block_matches_brute_force(spark):
    from kvlake.queries import _blocks, event_log

    index = {}
    for r in _blocks(spark, SF).collect():
        index.setdefault(r.file_number, []).append((r.block, r.last_key))
    keys = {(r.sequence // 1000 + i, r.key) for r in event_log(spark, SF).collect() for i in (0, 1)}
    want = {(f, k): min((b for b, last in index[f] if last >= k), default=max(index[f])[0]) for f, k in keys if f in index}
    got = QUERIES["kv_find_block"](spark, SF)
    assert {(r.file_number, r.key): r.block for r in got.collect()} == want and got.count() == len(want)


def test_block_index_of_a_run_in_several_ranges(spark):
    from kvlake.plans import manifest
    from kvlake.sources.workspace import Workspace

    log = spark.range(5000).selectExpr("id % 2 as file_number", "lpad(cast(id * 7919 % 5000 div 3 as string), 6, '0') as key", "id as sequence")
    want = {}
    for f in (0, 1):
        held = sorted(((r.key, -r.sequence) for r in log.where(f"file_number = {f}").collect()))
        want |= {(f, b): (held[b * 16 : b * 16 + 16][-1][0], len(held[b * 16 : b * 16 + 16])) for b in range(-(-len(held) // 16))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = manifest.block_index(log, 16, Workspace(spark, "t")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.file_number, r.block): (r.last_key, r.entries) for r in got} == want


def test_find_block_of_keys_that_fill_blocks_and_of_runs_without_index(spark):
    from kvlake.plans import manifest

    index = spark.createDataFrame([(1, 0, "b"), (1, 1, "d"), (1, 2, "d"), (1, 3, "f"), (2, 0, "c")], "file_number bigint, block int, last_key string")
    probes = spark.createDataFrame([(f, k) for f in (1, 2, 3) for k in "abcdefgg"], "file_number bigint, key string")
    got = {(r.file_number, r.key): r.block for r in manifest.find_block(index, probes).collect()}
    assert got == {(1, k): b for k, b in zip("abcdefg", (0, 0, 1, 1, 3, 3, 3), strict=True)} | {(2, k): 0 for k in "abcdefg"}
    plan = manifest.find_block(index, probes)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
