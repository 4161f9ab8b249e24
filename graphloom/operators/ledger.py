"""L: queues, ledgers and retries as tables. Times are epoch seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import SIGNAL

EDIT_TOOLS = ("Edit", "Write")
CURSOR_EDIT = r'"(?:Write|StrReplace|Edit|MultiEdit|EditNotebook)"|"file_path"'


def session_work_gate(events: DataFrame, turns: int = 6, tail: int = 20_000) -> DataFrame:
    """C3, first dialect: events(session_id, seq, role, tools array, raw) -> (session_id, user_turns, edits, signal, passes).

    V10: parsed events are counted. Only the last lines of a session that can reach into its last `tail` characters are
    joined.
    """
    after = F.sum(F.length("raw") + 1).over(Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1))
    last = events.withColumn("_after", F.coalesce(after, F.lit(0))).where(F.col("_after") < tail)
    text = last.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "raw"))), lambda s: s["raw"]), "\n").alias("text"))
    signal = text.select("session_id", F.substring("text", -tail, tail).rlike(SIGNAL).alias("signal"))
    edits = F.coalesce(F.max(F.arrays_overlap("tools", F.array(*map(F.lit, EDIT_TOOLS)))), F.lit(False))
    return _gate(events.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"), edits.alias("edits")), signal, turns)


def cursor_work_gate(events: DataFrame, turns: int = 6, tail: int = 20_000) -> DataFrame:
    """C4, second dialect: the edit shows as a tool's name or a `file_path` key anywhere in the raw lines."""
    base = session_work_gate(events.withColumn("tools", F.array().cast("array<string>")), turns, tail).select("session_id", "signal")
    return _gate(events.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"), F.max(F.col("raw").rlike(CURSOR_EDIT)).alias("edits")), base, turns)


def _gate(counts: DataFrame, signal: DataFrame, turns: int) -> DataFrame:
    return counts.join(signal, "session_id").withColumn("passes", (F.col("user_turns") >= turns) & F.col("edits") & F.col("signal"))


def enqueue(queue: DataFrame, closed: DataFrame) -> DataFrame:
    """L1: one row per session, the latest by ts."""
    rows = queue.unionByName(closed.select(*queue.columns))
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in queue.columns if c != "session_id"]), "ts").alias("r")).select("session_id", "r.*")


def find_transcripts(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """L1: (session_id, path): the file whose name is the session id."""
    named = files.withColumn("session_id", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1))
    return sessions.join(named, "session_id").groupBy("session_id").agg(F.min("path").alias("path"))


def prune_queue(queue: DataFrame, now: float, max_age: float) -> DataFrame:
    """L2: rows younger than max_age; a missing ts counts as 0."""
    return queue.where(F.coalesce("ts", F.lit(0.0)) >= now - max_age)


def queue_state(queue: DataFrame, files: DataFrame, processed: DataFrame, now: float, max_age: float = 48 * 3600, idle: float = 600) -> DataFrame:
    """L3: (session_id, state, age, idle): done, or stale, missing, ready, waiting; `*` where the file moved on since."""
    mtime = files.select("transcript_path", F.col("mtime").alias("_m"))
    done = processed.groupBy("session_id").agg(F.max("processed_mtime").alias("_p"))
    rows = queue.join(mtime, "transcript_path", "left").join(done, "session_id", "left").withColumn("_m", F.coalesce("_m", F.lit(0.0)))
    age, rest = F.lit(now) - F.coalesce("ts", F.lit(0.0)), F.when(F.col("_m") > 0, F.lit(now) - F.col("_m")).otherwise(F.lit(-1.0))
    state = F.when(age > max_age, "stale").when(F.col("_m") == 0, "missing").when(rest >= idle, "ready").otherwise("waiting")
    full = F.when(F.col("_p").isNull(), state).when(F.col("_m") > F.col("_p"), F.concat(state, F.lit("*"))).otherwise("done")
    return rows.select("session_id", full.alias("state"), age.alias("age"), rest.alias("idle"))


def drain_plan(queue: DataFrame, cap: int = 25) -> tuple[DataFrame, DataFrame]:
    """L4: the oldest `cap` rows with their place, and how many stay."""
    first = queue.orderBy("ts", "session_id").limit(cap)
    plan = first.select("session_id", "ts", F.row_number().over(Window.orderBy("ts", "session_id")).alias("place"))  # `cap` rows
    return plan, queue.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("remaining"))


def retry_ledger(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """attempts(session_id, ts, ok) -> (session_id, failures, state): failures since the last success."""
    ok = attempts.groupBy("session_id").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"), F.max("ts").alias("last"))
    since = attempts.join(ok, "session_id").where(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("ts") > F.col("last_ok")))).groupBy("session_id").agg(F.count(F.lit(1)).alias("failures"))
    rows = ok.join(since, "session_id", "left").select("session_id", F.coalesce("failures", F.lit(0)).alias("failures"))
    return rows.withColumn("state", F.when(F.col("failures") == 0, "processed").when(F.col("failures") >= limit, "dead").otherwise("retry"))


def pipeline_health(events: DataFrame, queue: DataFrame, processed: DataFrame, now: float) -> DataFrame:
    """One row over events(ts, event): hours since the last, depths, failures of seven days, two findings."""
    e = events.agg(F.max("ts").alias("last"), F.count_if((F.col("ts") >= now - 7 * 86400) & F.col("event").isin("failed", "no-container", "daycap-hit")).alias("bad"))
    n = lambda df, a: df.agg(F.count(F.lit(1)).alias(a))
    hours = F.round((F.lit(now) - F.col("last")) / 3600, 6)
    rows = e.crossJoin(n(queue, "queued")).crossJoin(n(processed, "processed"))
    return rows.select(hours.alias("hours"), "queued", "processed", "bad", F.coalesce(hours > 24, F.lit(True)).alias("stale"), (F.col("bad") >= 10).alias("failing"))


def last_drain(*logs: DataFrame) -> DataFrame:
    """The latest success over all logs(ts, event)."""
    rows = logs[0].select("ts", "event")
    for log in logs[1:]:
        rows = rows.unionByName(log.select("ts", "event"))
    return rows.where("event = 'ok'").agg(F.max("ts").alias("last_drain"))


def append_worklog(bodies: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bodies(session_id, day, time, project, body, mode) -> entries with their header form, and marker rows.

    Empty bodies and SKIP are dropped; the first entry of a day that the log lacks opens it.
    """
    rows = bodies.withColumn("body", F.trim("body")).where((F.col("body") != "") & (F.upper("body") != "SKIP"))
    rows = rows.join(days.select("day", F.lit(True).alias("_open")).distinct(), "day", "left").withColumn("_r", F.row_number().over(Window.partitionBy("day").orderBy("time", "session_id")))
    suffix = F.when(F.col("mode") == "continuation", " (continued)").otherwise("")
    below = F.concat(F.lit("### "), "time", F.lit(" | "), "project", suffix)
    header = F.when(F.col("_open").isNotNull() | (F.col("_r") > 1), below).when(F.col("mode") == "continuation", F.concat(F.lit("## "), "day", F.lit("\n\n"), below)).otherwise(F.concat(F.lit("## "), "day", F.lit(" | "), "project", F.lit(" | "), "time"))
    entries = rows.select("session_id", "day", "time", header.alias("header"), "body")
    return entries, entries.select("session_id", "day", "time")
