"""L1 to L5 as one state machine: a log of what happens to sessions, in; what state each is in, and since when, out.

events(session_id, ts, kind): `enqueue` queues a session, the latest entry counts; `file` says that its file was written;
`ok` and `failed` are attempts to process it. Beside what an event changes, time does: a file at rest for ten minutes makes
a session ready, two days in the queue make it stale, each at its own moment, by a timer or, where a later event of the
session comes first, before that event. So the changes don't depend on how the log is cut into batches. `clock` events,
of any session, only move time on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.ledger import drain_plan
from .triggers import ROCKS

IDLE_MS, STALE_MS, FAILURES = 600 * 1000, 48 * 3600 * 1000, 3
CHANGE = "session_id long, n long, ts timestamp, state string, ledger string, failures int, queued timestamp"
MEMORY = "queued long, written long, processed long, attempts int, failures int, state string, ledger string, n long"
COLUMNS = [c.split()[0] for c in CHANGE.split(", ")]


class Session:
    """What is known of a session; times in milliseconds."""

    def __init__(self, queued=None, written=None, processed=None, attempts=0, failures=0, state=None, ledger=None, n=0):
        self.queued, self.written, self.processed, self.attempts, self.failures = queued, written, processed, attempts or 0, failures or 0
        self.shown, self.n = (state, ledger), n or 0

    def memory(self) -> tuple:
        return (self.queued, self.written, self.processed, self.attempts, self.failures, *self.shown, self.n)

    def apply(self, kind: str, ms: int) -> None:
        if kind == "enqueue":
            self.queued = max(ms, self.queued or 0)
        elif kind == "file":
            self.written = max(ms, self.written or 0)
        elif kind == "ok":
            self.processed, self.failures, self.attempts = max(ms, self.processed or 0), 0, self.attempts + 1
        elif kind == "failed":
            self.failures, self.attempts = self.failures + 1, self.attempts + 1

    def state(self, now: int) -> str | None:
        """L3 at a time; none where the session isn't queued."""
        if self.queued is None:
            return None
        own = "stale" if now - self.queued > STALE_MS else "missing" if not self.written else "ready" if now - self.written >= IDLE_MS else "waiting"
        if self.processed is None:
            return own
        return f"{own}*" if (self.written or 0) > self.processed else "done"

    def ledger(self) -> str | None:
        """What the attempts have come to."""
        return None if not self.attempts else "processed" if not self.failures else "dead" if self.failures >= FAILURES else "retry"

    def deadlines(self, after: int) -> list[int]:
        """When time alone may change the state."""
        own = [] if self.queued is None else [self.queued + STALE_MS + 1, *([self.written + IDLE_MS] if self.written else [])]
        return sorted(d for d in own if d > after)

    def changes(self, now: int, anyway: bool = False) -> list[tuple]:
        """A row if what is shown differs now, or anyway."""
        new = self.state(now), self.ledger()
        if new == (None, None) or (new == self.shown and not anyway):
            return []
        self.shown, self.n = new, self.n + 1
        return [(self.n, now, *new, self.failures, self.queued)]


def replay(session: Session, events: list[tuple[int, str]], since: int) -> list[tuple]:
    """The changes that events (ms, kind), in order of time, and the deadlines between them bring; `since` is the time before."""
    out = []
    for ms, kind in events:
        while due := [d for d in session.deadlines(since) if d < ms]:
            since = due[0]
            out += session.changes(since)
        before = session.failures, session.queued
        session.apply(kind, ms)
        out += session.changes(ms, before != (session.failures, session.queued))
        since = max(since, ms)
    return out


class Queue(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("session", f"{MEMORY}, since long")

    def _load(self) -> tuple[Session, int]:
        if not self.memory.exists():
            return Session(), 0
        *own, since = self.memory.get()
        return Session(*own), since

    def _save(self, session: Session, since: int) -> None:
        self.memory.update((*session.memory(), since))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        for d in session.deadlines(since)[:1]:
            self.handle.registerTimer(d)

    @staticmethod
    def _rows(key, found: list[tuple]) -> pd.DataFrame:
        at = lambda x: pd.to_datetime(pd.Series(x, dtype="float64"), unit="ms")
        text = lambda x: pd.Series(x, dtype=object)  # noqa: E731  one Arrow array, not chunks
        rows = pd.DataFrame({"session_id": [key[0]] * len(found), "n": [r[0] for r in found], "ts": at([r[1] for r in found]), "state": text([r[2] for r in found]), "ledger": text([r[3] for r in found]), "failures": [r[4] for r in found], "queued": at([r[5] for r in found])})
        return rows[COLUMNS]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        found = found.assign(ms=found.ts.astype("datetime64[ms]").astype("int64")).sort_values(["ms", "kind"])
        session, since = self._load()
        out = replay(session, list(zip(found.ms.tolist(), found.kind.tolist(), strict=True)), since)
        self._save(session, max(since, int(found.ms.max())))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session, since = self._load()
        out, upto = [], max(int(expiredTimerInfo.getExpiryTimeInMs()), int(timerValues.getCurrentWatermarkInMs()))
        while due := [d for d in session.deadlines(since) if d <= upto]:
            since = due[0]
            out += session.changes(since)
        self._save(session, since)
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def queue_stream(events: DataFrame, out: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """events(session_id, ts, kind), a stream -> changes, written to `out`; runs until what is there is done."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    changes = events.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(Queue(), CHANGE, "append", "eventTime")
    return changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def states(changes: DataFrame, now: str | None = None) -> DataFrame:
    """(session_id, state, ledger, failures, queued) at a time, or after all changes."""
    rows = changes if now is None else changes.where(F.col("ts") <= F.lit(now).cast("timestamp"))
    return rows.groupBy("session_id").agg(F.max_by(F.struct("state", "ledger", "failures", "queued"), "n").alias("s")).select("session_id", "s.*")


def next_run(changes: DataFrame, now: str | None = None, cap: int = 25) -> tuple[DataFrame, DataFrame]:
    """L4: the `cap` sessions queued longest that are ready and not dead, with their place, and how many wait for later runs."""
    open_ = states(changes, now).where("state IN ('ready', 'ready*') AND coalesce(ledger, '') <> 'dead'")
    return drain_plan(open_.select("session_id", F.col("queued").alias("ts")), cap)
