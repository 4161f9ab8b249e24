"""H8, G11 and J7 on live streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lessons import SEVERITIES

DAY_MS = 24 * 3600 * 1000


def _until(state: GroupState, times: pd.Series) -> None:
    """Keep a session for 24 hours after its last event."""
    last = times.max()
    now = 0 if pd.isna(last) else int(pd.Timestamp(last).timestamp() * 1000)
    state.setTimeoutTimestamp(max(now, state.getCurrentWatermarkMs()) + DAY_MS)


def activate_stream_first(candidates: DataFrame, keep: str = "24 hours") -> DataFrame:
    """H8 without the cap: each lesson once a session within the watermark; candidates come from a stream-static join."""
    return candidates.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["session_id", "lesson"])


def activate_stream(candidates: DataFrame, cap: int = 2) -> DataFrame:
    """H8: by severity, at most `cap` an event and each lesson once a session; a session is forgotten after 24 hours.

    Events of a micro-batch are taken in time order; state is the lessons that the session has fired. Time is that of the
    events: a session ends when the watermark, 24 hours behind the latest event, has passed its last event by 24 hours.
    """
    columns = ["event_id", "ts", "lesson", "severity", "pattern"]
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    schema = f"session_id {kinds['session_id']}, " + ", ".join(f"{c} {kinds[c]}" for c in columns)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fired = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(batches))
        rows = rows.assign(o=rows.severity.map(SEVERITIES).fillna(len(SEVERITIES))).sort_values(["ts", "event_id", "o", "lesson"])
        out = []
        for _, event in rows.groupby(["ts", "event_id"], sort=False):
            fresh = event[~event.lesson.isin(fired)].drop_duplicates("lesson").head(cap)
            fired.update(fresh.lesson)
            out.append(fresh)
        state.update((sorted(fired),))
        _until(state, rows.ts)
        found = pd.concat(out)
        yield found.assign(session_id=key[0])[["session_id", *columns]]

    return candidates.withWatermark("ts", "24 hours").groupBy("session_id").applyInPandasWithState(run, schema, "fired array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def recall_stream(matches: DataFrame, emit_cap: int = 4) -> DataFrame:
    """G11 live: matches(session_id, turn, ts, question, names array) -> (session_id, turn, name, rank, first_fire)."""
    kinds = {f.name: f.dataType.simpleString() for f in matches.schema.fields}
    schema = f"session_id {kinds['session_id']}, turn {kinds['turn']}, name string, rank int, first_fire boolean"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(state.get[0]) if state.exists else set()
        fired = bool(state.exists and state.get[1])
        out = []
        rows = pd.concat(list(batches)).sort_values("turn")
        for r in rows.itertuples(index=False):
            names = list(r.names)
            fresh = [n for n in names if n not in seen]
            if names and (fresh or r.question):
                emit = fresh or names
                out += [(key[0], r.turn, n, i + 1, not fired) for i, n in enumerate(emit)]
                fired = True
                seen.update(emit[:emit_cap])
        state.update((sorted(seen), fired))
        _until(state, rows.ts)
        yield pd.DataFrame(out, columns=["session_id", "turn", "name", "rank", "first_fire"])

    return matches.withWatermark("ts", "24 hours").groupBy("session_id").applyInPandasWithState(run, schema, "seen array<string>, fired boolean", "append", GroupStateTimeout.EventTimeTimeout)


def process_sessions(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """J7 live: new session files, each once; the checkpoint is the ledger. Runs until what is there is done."""
    lines = spark.readStream.schema("value string").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
