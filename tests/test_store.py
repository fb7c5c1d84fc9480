import os
import random
import signal
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidelog.errors import DataCorrupted, DirectoryLocked, InvalidInput, ManifestError, ReadOnly, WritesStalled
from tidelog.options import Options
from tidelog.plans import store as stores
from tidelog.plans.store import Store
from tidelog.schema import OP_LOG

SMALL = Options(memtable_bytes=160 * 1024, segment_bytes=160 * 1024, level_base_bytes=200 * 1024, level_multiplier=2, l0_trigger=2)


def test_single_keys_and_reopening(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    s = Store(spark, root)
    s.put(b"a", b"1")
    s.put(b"a", b"2")
    s.put(b"e", b"")
    s.delete(b"never")
    assert s.get(b"a") == b"2" and s.get(b"e") == b"" and s.get(b"never") is None and s.get(b"x") is None
    assert s.locate(b"never") == -1 and s.locate(b"x") is None and s.stats()["held_records"] == 4
    with pytest.raises(DirectoryLocked):
        Store(spark, root)
    for key, value in ((b"k" * (16 * 1024 + 1), b""), (b"k", b"v" * (128 * 1024 + 1))):
        with pytest.raises(InvalidInput):
            s.put(key, value)
    s.put(b"a", b"3")
    s.close()
    s = Store(spark, root)
    assert s.get(b"a") == b"3" and s.locate(b"a") == 0 and s.stats()["levels"][0]["files"] == 1 and s.is_idle()
    with pytest.raises(ManifestError):
        s._commit([{"tag": "DELETE", "level": 0, "id": 12345}])
    assert s.get(b"a") == b"3"
    s.close()


def test_workload_with_compactions_against_a_dict(spark, tmp_path):
    rng = random.Random(4)
    root, model, n = f"file://{tmp_path}/s", {}, 0
    s = Store(spark, root, SMALL)
    for turn in range(8):
        rows = []
        for _ in range(1500):
            k = b"key%05d" % rng.randrange(2500)
            v = None if rng.random() < 0.2 else b"value%d-" % n + b"x" * 90
            rows.append((n, bytearray(k), None if v is None else bytearray(v), v is None, 1_000_000 + n // 7))
            model[k] = v
            n += 1
        s.write_ordered(spark.createDataFrame(rows, "n long, key binary, value binary, deleted boolean, now long"), "n", "now")
        if turn == 4:
            s.close()
            s = Store(spark, root, SMALL)
    s.flush()
    while s.maintenance():
        pass
    assert s.is_idle() and sum(x["files"] for x in s.stats()["levels"][1:]) > 1
    live = {bytes(r.key): bytes(r.value) for r in s.snapshot().collect()}
    assert live == {k: v for k, v in model.items() if v is not None}
    probes = spark.createDataFrame([(bytearray(b"key%05d" % k),) for k in range(0, 2600, 3)], "key binary")
    for r in s.multi_get(probes).collect():
        k = bytes(r.key)
        assert r.status == ("FOUND" if model.get(k) is not None else "DELETED" if k in model and r.status == "DELETED" else "ABSENT")
    scan = {bytes(r.key) for r in s.range_scan(b"key00100", b"key00199").collect()}
    assert scan == {k for k, v in model.items() if v is not None and b"key00100" <= k <= b"key00199"}
    files = sorted((f["level"], f["min_key"], f["max_key"]) for f in s.live.values())
    for (l1, _, high), (l2, low, _) in zip(files, files[1:]):
        assert l1 != l2 or l1 == 0 or high < low
    one = next(f for f in s.live.values() if f["level"] > 0)
    plan = s.range_scan(bytes.fromhex(one["min_key"]), bytes.fromhex(one["min_key"]))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan
    s.close()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    s = Store(spark, root)
    s.put(b"a", b"1")
    s.flush()
    s.close()
    (tmp_path / "s/segments/99999999999999999999").mkdir()
    s = Store(spark, root)
    assert len(list((tmp_path / "s/segments").iterdir())) == 1 and s.get(b"a") == b"1"
    s.close()


def test_stall(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", Options(l0_trigger=2, l0_stop=3))
    s.maintenance = lambda: False
    for k in range(3):
        s.put(b"k", b"%d" % k)
        s.flush()
    with pytest.raises(WritesStalled):
        s.put(b"k", b"x")
    s.close()


def test_stream_becomes_the_same_state(spark):
    from tidelog import queries
    from tests.oracle import oracle, rows_of

    got = queries.q25_streaming_latest(spark, "/root/testdata/sf0.001").toPandas()
    assert rows_of(got) == rows_of(oracle(queries.ORACLE_SQL["q25_streaming_latest"], "/root/testdata/sf0.001"))


def test_stream_of_several_batches(spark, tmp_path):
    from tidelog.operators import resolve
    from tidelog.streaming import ingest

    log = spark.createDataFrame([(bytearray(b"k%d" % (i % 7)), bytearray(b"%d" % i), i % 5 == 0, i) for i in range(70)], OP_LOG)
    log.withColumn("f", F.col("hlc") % 4).write.partitionBy("f").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(OP_LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ingest.start(stream, lambda b: b, f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/log")
    assert out.select("batch").distinct().count() > 1
    want = {(bytes(r.key), r.hlc) for r in resolve.newest(log, ["key"]).collect()}
    assert {(bytes(r.key), r.hlc) for r in resolve.newest(out.drop("batch"), ["key"]).collect()} == want


def test_command_lines(spark, tmp_path):
    from tidelog.__main__ import answers

    s = Store(spark, f"file://{tmp_path}/s")
    lines = ["put a some value ", "GET a", "get b", "", "put a", "del", "delete a", "get\ta", "scan x", "stats", "quit", "get a"]
    got = list(answers(s, lines))
    assert got[:3] == ["OK", "some value", "(None)"] and got[3].startswith("error") and got[4].startswith("error")
    assert got[5:7] == ["OK", "(None)"] and got[7].startswith("error") and "held_records" in got[8] and len(got) == 9
    s.close()


CHILD = """
import os, signal, sys, threading
from pyspark.sql import SparkSession
from tidelog.plans.store import Store
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
store = Store(spark, sys.argv[1])
store.put(b"acknowledged", b"1")
threading.Timer(4, lambda: os.kill(os.getpid(), signal.SIGKILL)).start()
store.write(spark.range(10**12).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS key", "CAST('x' AS BINARY) AS value", "false AS deleted", "id AS hlc"))
"""


def test_reopening_after_a_kill(spark, tmp_path):
    """A process killed in the middle of a write leaves its lock and an unfinished batch; what it acknowledged stays."""
    root = f"file://{tmp_path}/s"
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    child = subprocess.run([sys.executable, "-c", CHILD, root], env=env, capture_output=True, timeout=120)
    assert child.returncode == -signal.SIGKILL, child.stderr[-2000:]
    assert (tmp_path / "s/LOCK").exists() and (tmp_path / "s/wal/0/batch=00000001").exists() and not (tmp_path / "s/wal/0/batch=00000001/_SUCCESS").exists()
    with pytest.raises(DataCorrupted):
        Store(spark, root, Options(wal_recovery="absolute_consistency"))
    s = Store(spark, root)
    assert s.get(b"acknowledged") == b"1" and s.snapshot().count() == 1
    s.put(b"later", b"2")
    s.close()
    with pytest.raises(ReadOnly):
        s.put(b"closed", b"3")
    assert {bytes(r.key) for r in Store(spark, root).snapshot().collect()} == {b"acknowledged", b"later"}


def batch(spark, root, wal, ops):
    rows = [(bytearray(k), bytearray(v), False, h) for k, v, h in ops]
    spark.createDataFrame(rows, OP_LOG).write.parquet(f"{root}/wal/{wal}/batch=00000000")


def test_logs_are_replayed_by_number(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    batch(spark, root, 9, [(b"nine", b"9", 5)])
    batch(spark, root, 10, [(b"ten", b"10", 6)])
    s = Store(spark, root)
    assert s.get(b"nine") == b"9" and s.get(b"ten") == b"10" and s.wal == 11
    s.close()


def test_failures_are_tried_again(spark, tmp_path, monkeypatch):
    root, fails = f"file://{tmp_path}/s", []
    s = Store(spark, root, Options(flush_retries=2))
    written = Store._written

    def flaky(self, rows, level, name):
        out = written(self, rows, level, name)
        if fails:
            raise OSError(fails.pop())
        return out

    monkeypatch.setattr(Store, "_written", flaky)
    s.put(b"a", b"1")
    fails.append("once")
    s.flush()
    assert s.get(b"a") == b"1" and s.locate(b"a") == 0 and not s.failed and len(list((tmp_path / "s/segments").iterdir())) == 1
    s.put(b"b", b"2")
    fails += ["again"] * 3
    with pytest.raises(OSError):
        s.flush()
    with pytest.raises(ReadOnly):
        s.put(b"c", b"3")
    assert s.get(b"b") == b"2"  # reads go on
    s.close()
    s = Store(spark, root)
    assert s.get(b"b") == b"2" and s.locate(b"b") == 0
    s.close()


def test_manifest_snapshot_missing_files_and_prefixes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "SNAPSHOT_AFTER", 2)
    root, keys = f"file://{tmp_path}/s", [b"p", b"pa", b"pa\xff", b"pb", b"q"]
    for k in keys:
        s = Store(spark, root)
        s.put(k, k)
        s.close()
    s = Store(spark, root)
    names = sorted(x.name for x in (tmp_path / "s/manifest").iterdir() if not x.name.startswith("."))
    assert sum(n.endswith(".snapshot") for n in names) == 1 and len(names) <= 4
    scan = lambda prefix: {bytes(r.key) for r in s.prefix_scan(prefix).collect()}
    assert scan(b"p") == set(keys[:4]) and scan(b"pa") == set(keys[1:3]) and scan(b"pa\xff") == {keys[2]} and scan(b"") == set(keys) and scan(b"x") == set()
    f = next(iter(s.live.values()))
    s.close()
    s.folder.delete(f"segments/{f['file']}/{f['part']}")
    with pytest.raises(DataCorrupted):
        Store(spark, root)
    assert not (tmp_path / "s/LOCK").exists()


def test_deleted_keys_at_the_bottom_level(spark, tmp_path):
    """Dropped there by default, as the reference does; kept if the store is to tell deleted from absent."""
    log = spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"), False, 1), (bytearray(b"b"), bytearray(b"2"), False, 2), (bytearray(b"b"), None, True, 3)], OP_LOG)
    probes = spark.createDataFrame([(bytearray(k),) for k in (b"a", b"b", b"c")], "key binary")
    for keep, status in ((False, "ABSENT"), (True, "DELETED")):
        s = Store(spark, f"file://{tmp_path}/{keep}", Options(keep_tombstones=keep))
        s.write(log)
        s.flush()
        s._compact(2, list(s.live))
        assert {f["level"] for f in s.live.values()} == {3} and s.get(b"b") is None and s.snapshot().count() == 1
        assert {bytes(r.key): r.status for r in s.multi_get(probes).collect()} == {b"a": "FOUND", b"b": status, b"c": "ABSENT"}
        s.close()


def test_multi_get_of_a_store_compacted_to_the_bottom(spark, monkeypatch):
    """Q33 with level 1 as the bottom, which larger tables reach at level 3."""
    from tests.oracle import SF, oracle, rows_of
    from tidelog import store_queries
    from tidelog.operators import compaction

    monkeypatch.setattr(compaction, "BOTTOM", 1)
    got = rows_of(store_queries.q33_store_multi_get(spark, SF).toPandas())
    assert got == rows_of(oracle(store_queries.ORACLE_SQL["q33_store_multi_get"])) and any("'DELETED'" in r for r in got)
