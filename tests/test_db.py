"""The table object: contract, recovery, compaction, and a model check."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvlake.db import Database
from kvlake.functions import codec
from kvlake.operators.batch import WriteBatch
from kvlake.plans import compaction, manifest
from kvlake.plans.compaction import RunFile
from kvlake.schema import Corruption, InvalidArgument, KvError, Options, ReadOptions, WriteOptions, WriteStall
from kvlake.sources.journal import pack, unpack
from kvlake.streaming import tail

SMALL = Options(rows_per_file=1000)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def rows(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def fill(db, first, last, value):
    batch = WriteBatch()
    for i in range(first, last):
        batch.put(f"key{i:04d}", value(i) if callable(value) else value)
    db.write(batch)


def test_put_get_delete_overwrite(spark, path):
    db = Database.open(spark, path)
    db.put("key1", "value1")
    db.put("key2", b"value2")
    db.put("key2", b"newer")
    db.delete("key1")
    db.delete("never there")
    assert db.get("key1") is None and db.get("key2") == b"newer" and db.get("nonexistent") is None
    with pytest.raises(InvalidArgument):
        db.put(1, "x")
    db.close()
    with pytest.raises(KvError):
        db.put("a", "b")


def test_batches_apply_in_order(spark, path):
    db = Database.open(spark, path)
    db.write(WriteBatch())
    assert db.last_sequence == 0
    batch = WriteBatch().put("k1", "v1").put("k2", "v2").delete("k1")
    assert len(batch) == 3 and not batch.is_empty
    db.write(batch)
    assert db.get("k1") is None and db.get("k2") == b"v2" and db.last_sequence == 3
    db.write(WriteBatch().put("a", "1").delete("k2"))
    db.put("k2", "again")  # no sequence is used twice
    assert db.get("k2") == b"again" and db.last_sequence == 6


def test_scan_bounds_limit_and_sources(spark, path):
    db = Database.open(spark, path)
    fill(db, 0, 50, lambda i: f"sst{i}")
    db.flush()
    fill(db, 50, 100, lambda i: f"mem{i}")
    got = rows(db.scan("key0040", "key0060", 100))
    assert [k for k, _ in got] == [f"key{i:04d}".encode() for i in range(40, 60)]
    assert [v for _, v in got] == [f"sst{i}".encode() for i in range(40, 50)] + [f"mem{i}".encode() for i in range(50, 60)]
    assert len(rows(db.scan("key0000", "key0100", 5))) == 5
    assert rows(db.scan("key0010", "key0020", 0)) == [] == rows(db.scan("key0020", "key0010")) == rows(db.scan("x", "x"))
    assert rows(db.scan("zzz", "zzzz")) == []
    fill(db, 20, 30, "new")
    db.write(WriteBatch([(2, f"key{i:04d}".encode(), None) for i in range(30, 35)]))
    got = rows(db.scan("key0015", "key0035"))
    assert len(got) == 15 and sum(v == b"new" for _, v in got) == 10


def test_keys_are_bytes_in_unsigned_order(spark, path):
    db = Database.open(spark, path)
    keys = [b"", b"\x00", b"a", b"ab", b"abc", b"b", b"\x7f", b"\x80", b"\xff", b"k" * 257, b"k" * 504, b"k" * 600]
    for turn in range(2):
        for k in keys:
            db.put(k, b"" if k == b"a" else k + bytes([turn]))
        db.flush()
    assert [k for k, _ in rows(db.live())] == sorted(keys)
    assert [k for k, _ in rows(db.scan(b"a", b"aa"))] == [b"a"]
    assert [k for k, _ in rows(db.scan(b"ab", b"b"))] == [b"ab", b"abc"]
    assert db.get(b"a") == b"" and db.get(b"") == b"\x01" and db.get(b"k" * 600) == b"k" * 600 + b"\x01"


def test_overwrite_across_runs_and_snapshots(spark, path):
    db = Database.open(spark, path)
    db.put("k", "1")
    snapshot = db.snapshot()
    db.flush()
    db.put("k", "2")
    db.flush()
    assert db.get("k") == b"2" and rows(db.scan("k", "l")) == [(b"k", b"2")]
    old = ReadOptions(snapshot=snapshot)
    assert db.get("k", old) == b"1" and db.get("k", ReadOptions(snapshot=0)) is None
    fill(db, 0, 3, "x")
    db.flush()
    db.delete("k")
    db.flush()
    assert db.compact() is not None
    assert db.get("k") is None and db.get("k", old) == b"1"
    db.release(snapshot)


def test_deleted_keys_stay_deleted_through_compaction(spark, path):
    options = Options(l0_compaction_trigger=2, base_level_size=1)
    db = Database.open(spark, path, options)
    db.put("k", "deep")
    db.flush()
    db.put("other", "x")
    db.flush()
    db.compact()
    db.compact()  # level 1 is over its target: to level 2
    assert {f.level for f in db.files.values()} == {2}
    db.delete("k")
    db.flush()
    db.put("j", "x")
    db.flush()
    db.compact()
    assert db.get("k") is None and [k for k, _ in rows(db.live())] == [b"j", b"other"]
    while db.compact():
        assert db.get("k") is None
    levels = [f for f in db.files.values() if f.level > 0]
    assert all(not a.overlaps(b.min_key, b.max_key) for a in levels for b in levels if a is not b and a.level == b.level)


def test_reopen_recovers_log_and_manifest(spark, path):
    db = Database.open(spark, path)
    fill(db, 0, 30, lambda i: f"value{i}")
    db.flush()
    db.put("later", "1")
    db.put("unsynced", "x", WriteOptions(sync=False))
    db.close()
    db = Database.open(spark, path)
    assert db.get("key0007") == b"value7" and db.get("later") == b"1" and db.get("unsynced") == b"x"
    before = db.last_sequence
    db.put("after", "2")
    assert db.last_sequence == before + 1
    db.flush()
    numbers = set(db.files)
    db = Database.open(spark, path)
    assert db.get("after") == b"2" and len(rows(db.live())) == 33
    db.put("more", "3")
    assert db.flush().file_number not in numbers


def test_torn_log_is_cut_at_the_first_bad_record(spark, path):
    db = Database.open(spark, path)
    for i in range(4):
        db.put(f"k{i}", "v")
    name = db.wal._name(3)
    record = bytearray(db.folder.read(name))
    record[-3] ^= 1
    db.folder.write(name, bytes(record), replace=True)
    db = Database.open(spark, path)
    assert [k for k, _ in rows(db.live())] == [b"k0", b"k1"]
    db.put("k9", "v")
    assert [k for k, _ in rows(Database.open(spark, path).live())] == [b"k0", b"k1", b"k9"]
    with pytest.raises(Corruption):
        unpack(pack({"a": 1})[:-1] + b"!")


def test_empty_flush_and_idle_compaction_make_nothing(spark, path):
    db = Database.open(spark, path)
    assert db.flush() is None and db.compact() is None and not db.files


def test_a_full_buffer_is_flushed_and_stalls_are_raised(spark, path):
    db = Database.open(spark, path, Options(memtable_size=1, l0_stop_trigger=3, l0_slowdown_trigger=2))
    for i in range(3):
        db.put(f"k{i}", "v")
    assert len(db.files) == 3 and db.stall_status() == "STOP"
    with pytest.raises(WriteStall):
        db.put("x", "y")
    assert Options().but(memtable_size=7).memtable_size == 7


def test_frames_are_written_as_one_batch(spark, path):
    db = Database.open(spark, path)
    db.put("key5", "old")
    frame = spark.range(1000).selectExpr("id as n", "if(id % 10 = 9, 2, 1) as op", "concat('key', cast(id % 500 as string)) as key", "cast(id as string) as value")
    db.write_frame(frame, "n")
    assert db.get("key5") == b"505" and db.get("key9") is None and len(rows(db.live())) == 450
    with pytest.raises(InvalidArgument):
        db.write_frame(frame.selectExpr("op", "key", "value", "0 as n"), "n")
    found = {bytes(r.key): r.found for r in db.multi_get(spark.createDataFrame([(bytearray(b"key5"),), (bytearray(b"key9"),)], "key binary")).collect()}
    assert found == {b"key5": True, b"key9": False}
    assert db.files_frame().count() == 2 and manifest.level_stats(db.files_frame()).first()["files"] == 2


def test_picker_policy():
    def run(level, number, size=1000, low=b"a", high=b"z"):
        return RunFile(level, number, size, 1, low, high, 0, 0)

    options = Options()
    assert compaction.pick_compaction([run(0, i) for i in range(3)], options) is None
    task = compaction.pick_compaction([run(0, i) for i in range(4)] + [run(1, 9)], options)
    assert (task.level, task.output_level, len(task.inputs)) == (0, 1, 5)
    task = compaction.pick_compaction([run(1, 1, 20 << 20, b"m", b"n"), run(2, 2, 5, b"a", b"b")], options)
    assert (task.level, task.output_level, len(task.inputs)) == (1, 2, 1)
    assert [compaction.target_size(n, options) >> 20 for n in (1, 2, 3)] == [10, 100, 1000]
    assert compaction.needs_compaction([run(0, i) for i in range(4)], options)


def test_codecs():
    assert codec.encode_internal_key(b"a", 1, 1).hex().upper() == "61FFFFFFFFFFFFFFFE01"
    assert codec.decode_internal_key(codec.encode_internal_key(b"xyz", 77, 0)) == (b"xyz", 77, 0)
    assert codec.decode_internal_key(b"short") is None
    for n in (0, 1, 127, 128, 300, (1 << 64) - 1):
        assert codec.decode_varint(codec.encode_varint(n) + b"x") == (n, len(codec.encode_varint(n)))
    assert codec.decode_varint(b"\x80") is None and codec.decode_varint(b"\xff" * 10) is None


def test_varints_of_a_column_are_those_of_python(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**62, 2**63 - 1, -1]
    rows = spark.createDataFrame([(v,) for v in values], "n long").select("n", codec.varint(F.col("n")).alias("v")).collect()
    assert all(bytes.fromhex(r.v) == codec.encode_varint(r.n % 2**64) for r in rows)


def test_stream_fold_equals_batch(spark, tmp_path):
    from kvlake.operators.resolve import live
    from kvlake.queries import event_log

    log = event_log(spark, "/root/testdata/sf0.001")
    log.repartition(5).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/log")
    q = tail.fold_stream(stream).writeStream.format("memory").queryName("state").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, tail.live_rows(spark.table("state")).collect())) == sorted(map(tuple, live(log).select("key", "value").collect()))


def test_stream_writes_batches(spark, tmp_path):
    ops = spark.range(40).selectExpr("id as n", "1 as op", "concat('k', cast(id % 7 as string)) as key", "cast(id as string) as value")
    ops.coalesce(1).write.parquet(f"{tmp_path}/ops")
    db = Database.open(spark, f"file://{tmp_path}/table")
    stream = spark.readStream.schema(ops.schema).parquet(f"{tmp_path}/ops")
    q = tail.write_stream(stream, db, "n", f"{tmp_path}/check").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {k: v for k, v in rows(db.live())} == {f"k{i % 7}".encode(): str(i).encode() for i in range(40)}


# ------------------------------------------------------------------- crashes


class Crash(Exception):
    pass


def crash_at(monkeypatch, target, name, turn=1):
    """The named step raises before it takes effect, from its ``turn``-th call on."""
    real, calls = getattr(target, name), []

    def step(*args, **kwargs):
        calls.append(1)
        if len(calls) >= turn:
            raise Crash(name)
        return real(*args, **kwargs)

    monkeypatch.setattr(target, name, step)


def test_a_crash_before_the_edit_leaves_no_run_and_no_number(spark, path, monkeypatch):
    db = Database.open(spark, path)
    fill(db, 0, 10, "a")
    with monkeypatch.context() as m:
        crash_at(m, db.manifest, "append")
        with pytest.raises(Crash):
            db.flush()
    assert db.folder.names("runs") == [f"{1:012d}"]
    db = Database.open(spark, path)
    assert db.folder.names("runs") == [] and len(rows(db.live())) == 10
    assert db.flush().file_number > 1 and len(rows(Database.open(spark, path).live())) == 10


@pytest.mark.parametrize("step", ["append", "remove"])
def test_a_crash_in_a_compaction_changes_no_answer(spark, path, monkeypatch, step):
    options = Options(l0_compaction_trigger=2)
    db = Database.open(spark, path, options)
    for i in range(2):
        fill(db, 5 * i, 5 * i + 10, f"v{i}")
        db.flush()
    before = rows(db.live())
    with monkeypatch.context() as m:
        crash_at(m, db.manifest if step == "append" else db.folder, step)
        with pytest.raises(Crash):
            db.compact()
    assert len(db.folder.names("runs")) == 3
    db = Database.open(spark, path, options)
    assert rows(db.live()) == before and len(db.folder.names("runs")) == len(db.files) == (2 if step == "append" else 1)
    db.compact()
    assert rows(db.live()) == before


@pytest.mark.parametrize("step", ["append", "point_to", "clean"])
def test_a_crash_in_a_checkpoint_changes_no_answer(spark, path, monkeypatch, step):
    db = Database.open(spark, path)
    for i in range(3):
        fill(db, i, i + 2, f"v{i}")
        db.flush()
    with monkeypatch.context() as m:
        crash_at(m, db.manifest, step)
        with pytest.raises(Crash):
            db.checkpoint()
    db = Database.open(spark, path)
    assert len(db.files) == 3 and rows(db.live()) == [(f"key{i:04d}".encode(), f"v{min(i, 2)}".encode()) for i in range(4)]
    db.checkpoint()
    assert len(db.manifest.numbers()) == 1 and db.manifest.current() == db.manifest.numbers()[0]
    db.put("more", "1")
    db.flush()
    db = Database.open(spark, path)
    assert len(db.files) == 4 and db.edits_since == 2 and db.get("more") == b"1"


def test_checkpoints_keep_the_manifest_short(spark, path):
    options = Options(checkpoint_edits=3, l0_stop_trigger=100, l0_slowdown_trigger=100)
    db = Database.open(spark, path, options)
    for i in range(8):
        db.put(f"k{i}", "v")
        db.flush()
        assert len(db.manifest.numbers()) <= 3
    assert len(Database.open(spark, path, options).files) == 8


def test_a_stream_batch_is_applied_once_wherever_it_stopped(spark, path, monkeypatch):
    frame = spark.createDataFrame([(0, 1, "a", "1"), (1, 1, "b", "2")], "n long, op int, key string, value string")
    db = Database.open(spark, path)
    with monkeypatch.context() as m:
        crash_at(m, db.manifest, "append")
        with pytest.raises(Crash):
            db.write_frame(frame, "n", stream_batch=0)
    db = Database.open(spark, path)
    assert rows(db.live()) == [] and db.stream_batch == -1
    db.write_frame(frame, "n", stream_batch=0)
    db = Database.open(spark, path)
    assert db.stream_batch == 0 and db.write_frame(frame, "n", stream_batch=0) is None
    assert len(db.files) == 1 and db.last_sequence == 2
    assert db.write_frame(frame.limit(0), "n", stream_batch=1) is None
    assert Database.open(spark, path).stream_batch == 1


def test_damage_inside_the_manifest_deletes_no_run(spark, path):
    db = Database.open(spark, path)
    for i in range(3):
        db.put(f"k{i}", "v")
        db.flush()
    db.folder.write(db.manifest._name(2), b"00000000 {}", replace=True)
    db = Database.open(spark, path)
    assert len(db.files) == 1 and len(db.folder.names("runs")) == 3
    db.put("k9", "v")
    assert db.flush().file_number == 4


def test_replacing_a_file_is_one_rename(spark, path):
    db = Database.open(spark, path)
    db.folder.write("x", b"one")
    with pytest.raises(FileExistsError):
        db.folder.write("x", b"two")
    db.folder.write("x", b"two", replace=True)
    assert db.folder.read("x") == b"two" and [n for n in db.folder.names("") if n.endswith(".tmp")] == []


# --------------------------------------------------- shared writers and cache


def test_threads_share_log_records(spark, path):
    import threading

    db = Database.open(spark, path)
    writer = db.group_commit(sync_wait=0.3)
    waits, lock = [], threading.Lock()

    def work(t):
        for i in range(5):
            done = writer.submit(WriteBatch().put(f"t{t}i{i}", "x").put("last", f"{t}"))
            with lock:
                waits.append(done)

    threads = [threading.Thread(target=work, args=(t,)) for t in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    bad = writer.submit(WriteBatch([(1, 5, None)]))
    writer.close()
    assert sorted(w.result() for w in waits) == [2 * i + 2 for i in range(30)]
    assert isinstance(bad.exception(), Exception)
    assert len(db.wal.numbers()) == len([g for g in writer.groups if g]) < 30 and sum(writer.groups) == 31
    with pytest.raises(KvError):
        writer.submit(WriteBatch().put("a", "b"))
    writer.close()
    assert len(rows(Database.open(spark, path).live())) == 31


def test_runs_stay_in_the_cache_by_last_use(spark, path):
    db = Database.open(spark, path, Options(block_cache_size=400, l0_stop_trigger=100, l0_slowdown_trigger=100, l0_compaction_trigger=3))
    for i in range(3):
        fill(db, 10 * i, 10 * i + 10, "v" * 3)  # 190 bytes a run
        db.flush()
    fill(db, 50, 90, "v" * 3)  # larger than the cache
    db.flush()
    a, b, c, big = sorted(db.files)
    assert len(rows(db.live())) == 70 and big not in db.cache and a not in db.cache and b in db.cache and c in db.cache
    assert db.get("key0015") == b"vvv" and db.cache.hits == 1 and db.get("key0005") == b"vvv"
    assert a in db.cache and b in db.cache and c not in db.cache and db.cache.used <= 400
    db.compact()
    assert a not in db.cache and len(rows(db.live())) == 70
    db.close()
    assert db.cache.used == 0


def test_runs_are_cut_in_files_by_rows(spark, path):
    db = Database.open(spark, path, SMALL)
    frame = spark.range(3500).selectExpr("id as n", "1 as op", "lpad(cast(id as string), 6, '0') as key", "'v' as value")
    run = db.write_frame(frame, "n")
    assert 3 <= len([n for n in db.folder.names(f"runs/{run.file_number:012d}") if n.endswith(".parquet")]) <= 4 and db.live().count() == 3500


KEYS = st.sampled_from([b"", b"a", b"ab", b"abc", b"b", b"\xff"])
STEPS = st.lists(
    st.one_of(
        st.tuples(st.just("put"), KEYS, st.binary(max_size=3)),
        st.tuples(st.just("delete"), KEYS),
        st.tuples(st.sampled_from(["flush", "compact", "reopen"])),
    ),
    max_size=14,
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(STEPS)
def test_model(spark, tmp_path_factory, steps):
    path = f"file://{tmp_path_factory.mktemp('model')}/t"
    options = Options(l0_compaction_trigger=2, base_level_size=1)
    db, model = Database.open(spark, path, options), {}
    for step in steps:
        if step[0] == "put":
            db.put(step[1], step[2])
            model[step[1]] = step[2]
        elif step[0] == "delete":
            db.delete(step[1])
            model.pop(step[1], None)
        elif step[0] == "reopen":
            db.close()
            db = Database.open(spark, path, options)
        else:
            getattr(db, step[0])()
    assert rows(db.live()) == sorted(model.items())
    assert all(db.get(k) == model.get(k) for k in (b"", b"a", b"ab", b"zz"))
