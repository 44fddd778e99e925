"""Run states on a stream against those in batch."""

import random

from pyspark.sql import functions as F

from cliploom.streaming import run_state

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lines_of(runs=4, n=60):
    rnd = random.Random(9)
    rows = []
    for r in range(runs):
        for i in range(n):
            line = rnd.choice(["Discovered 9 assets", "Matched 3", "noise", "", f"[==..]  {i}/{n} assets | elapsed {i}s | eta 1m | clip {i} | x ", f"[==] {i}/x assets | elapsed | eta | a"])
            rows.append((f"run {r}", i // 20, i, f"2024-01-01 0{i // 20}:{i % 20:02d}:00", line if r else "noise"))
    return rows


def test_batch(spark):
    rows = [("a", 1, "Matched 2"), ("a", 2, "[=.] 1/4 assets | elapsed 3s | eta 9s | one "), ("a", 3, "[==] 2/4 assets | elapsed 6s | eta 6s | two"), ("b", 1, "hello")]
    got = {r.run_id: r for r in run_state.run_states(spark.createDataFrame(rows, "run_id string, line_no int, line string"), ring=2).collect()}
    a, b = got["a"], got["b"]
    assert (a.processed, a.total, a.elapsed, a.eta, a.current_asset, a.status, a.n_lines) == (2, 4, "6s", "6s", "two", "running", 3) and a.logs == [rows[1][2], rows[2][2]]
    assert (b.processed, b.elapsed, b.status, b.logs) == (0, "", "idle", ["hello"])


def test_stream_equals_batch(spark, tmp_path):
    rows = lines_of()
    frame = spark.createDataFrame(rows, "run_id string, part int, line_no int, t string, line string").select("run_id", "part", "line_no", F.to_timestamp("t").alias("ts"), "line")
    # Three files, three batches: the ring and the record go from one to the next.
    for i in range(3):
        frame.where(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream = spark.readStream.schema("run_id string, line_no int, ts timestamp, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = run_state.streamed_run_states(stream, ring=25, quiet=7200.0)
        q = found.writeStream.outputMode("update").format("memory").queryName("run_states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    told = spark.table("run_states").collect()
    last = {}
    for r in told:
        if not r.closed and r.n_lines > (last[r.run_id].n_lines if r.run_id in last else 0):
            last[r.run_id] = r
    want = {r.run_id: r for r in run_state.run_states(frame, ring=25).collect()}
    columns = [f.split()[0] for f in run_state.STATE.split(", ")]
    assert {k: tuple(r[c] for c in columns) for k, r in last.items()} == {k: tuple(r[c] for c in columns) for k, r in want.items()}
    assert all(len(r.logs) == 25 for r in want.values()) and len(told) > len(want)
