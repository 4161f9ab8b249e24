"""The queue as a state machine against the batch ledgers."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from graphloom.operators import ledger
from graphloom.streaming import queue as Q

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def log(n=40):
    rnd = random.Random(3)
    rows = []
    for s in range(n):
        t = rnd.uniform(0, 3600)
        for _ in range(rnd.randint(1, 14)):
            t += rnd.choice([5, 300, 599, 600, 601, 4000, 80_000])
            rows.append((s, int(t * 1000), rnd.choice(["enqueue", "file", "file", "ok", "failed", "failed"])))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def batch(spark, rows, now):
    """What L1, L3 and L5 say of the log up to a time."""
    upto = [r for r in rows if r[1] <= now]
    frame = lambda kind, c: spark.createDataFrame([(s, float(t)) for s, t, k in upto if k == kind], f"session_id long, {c} double")
    queued = frame("enqueue", "ts").withColumn("transcript_path", F.col("session_id").cast("string"))
    entries = ledger.enqueue(queued.limit(0), queued)
    files = frame("file", "mtime").groupBy(F.col("session_id").cast("string").alias("transcript_path")).agg(F.max("mtime").alias("mtime"))
    state = ledger.queue_state(entries, files, frame("ok", "processed_mtime"), float(now), Q.STALE_MS, Q.IDLE_MS).select("session_id", "state")
    attempts = spark.createDataFrame([(s, float(t), k == "ok") for s, t, k in upto if k in ("ok", "failed")], "session_id long, ts double, ok boolean")
    tried = ledger.retry_ledger(attempts).select("session_id", F.col("state").alias("ledger"), "failures")
    return {r["session_id"]: (r["state"], r["ledger"], r["failures"] or 0) for r in state.join(tried, "session_id", "full").collect()}


def at(ms):
    return (START + timedelta(milliseconds=ms)).strftime("%Y-%m-%d %H:%M:%S.%f")


def replayed(spark, rows, folder, cuts):
    """The log as a stream in parts, and then the clock."""
    schema = "session_id long, ts timestamp, kind string"
    end = rows[-1][1] + 3 * 86_400_000
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)] + [[(-1, end + 3_600_000 + 5000, "clock")]]
    for part in parts:
        df = spark.createDataFrame([(s, at(t), k) for s, t, k in part], "session_id long, ts string, kind string")
        df.withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(f"file://{folder}/log")
        Q.queue_stream(spark.readStream.schema(schema).parquet(f"file://{folder}/log"), f"file://{folder}/out", f"file://{folder}/state").awaitTermination()
    return spark.read.schema(Q.CHANGE).parquet(f"file://{folder}/out"), end


def test_replay_gives_the_ledgers(spark, tmp_path):
    rows = log()
    changes, end = replayed(spark, rows, f"{tmp_path}/a", [])
    whole = sorted(map(tuple, changes.collect()), key=str)
    half = rows[len(rows) // 2][1]
    for now in (half, end):
        got = {r["session_id"]: (r["state"], r["ledger"], r["failures"]) for r in Q.states(changes, at(now)).collect()}
        assert got == batch(spark, rows, now)
    assert len({v for v, _, _ in batch(spark, rows, half).values()}) >= 4
    parts, _ = replayed(spark, rows, f"{tmp_path}/b", [len(rows) // 3, len(rows) // 2])
    assert sorted(map(tuple, parts.collect()), key=str) == whole  # however the log is cut
    plan, rest = Q.next_run(changes, at(half), cap=2)
    ready = sorted((max(t for s2, t, k in rows if s2 == s and k == "enqueue" and t <= half), s) for s, (st, le, _) in batch(spark, rows, half).items() if (st or "").startswith("ready") and le != "dead")
    assert [r["session_id"] for r in plan.orderBy("place").collect()] == [s for _, s in ready[:2]] and rest.first()["remaining"] == max(0, len(ready) - 2)


def test_time_alone():
    s = Q.Session()
    got = Q.replay(s, [(1000, "enqueue"), (2000, "file"), (400_000_000, "clock")], 0)
    assert [(ms, state) for _, ms, state, *_ in got] == [(1000, "missing"), (2000, "waiting"), (602_000, "ready"), (1000 + Q.STALE_MS + 1, "stale")]
    got = Q.replay(s, [(400_000_001, "failed"), (400_000_002, "failed"), (400_000_003, "failed"), (400_000_004, "ok")], 400_000_000)
    assert [(state, le, n) for _, _, state, le, n, _ in got] == [("stale", "retry", 1), ("stale", "retry", 2), ("stale", "dead", 3), ("done", "processed", 0)]
