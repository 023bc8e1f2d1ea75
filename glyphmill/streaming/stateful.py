"""Limits and job logs on streams, by keyed state with event-time timers; each has a batch twin that gives the same rows.

Rows of a key wait in its state until the watermark has passed them, and are then taken in order of (ts, id), so what comes out
doesn't depend on the order in which they came in, nor on restarts. Timers wake a key when its
next row is settled, and when its state has become old, which is then dropped. Rows behind the watermark are late and dropped.
Waiting rows are sorted outside of memory, as runs in the state, so a key may have as many as it will.

The session's state store is to be RocksDB (``stateful_session`` makes one); state, and the progress of a query, lie in its checkpoint folder.

Edges: rows with a null ts have no place in time and are dropped; rows with a null key share one; rows that repeat
are rows of their own.
"""

from __future__ import annotations

import heapq
import pickle
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from glyphmill.session import shared_folder
from glyphmill.streaming.jobs import MAX_EVENTS, MAX_JOBS, TTL_SECONDS, JobTable

_MICROS = 1_000_000
#: Times of the column that the watermark follows are kept in this range, as they pass through pandas; rows have their own in microseconds.
_FIRST, _LAST = 0, 9_214_646_400 * _MICROS


def _place(row: tuple):
    """Where a row (us, id, job, kind) comes in its key's order; a null id comes first of its time."""
    return row[0], row[1] is not None, row[1] or 0


class InOrder(StatefulProcessor):
    """Holds a key's rows until they are settled. Subclasses say what to do with settled ones, and when the state is old.

    What waits lies in the state as runs of RUN rows in order, in blocks of BLOCK rows, and is merged from the runs when it is settled. So a task
    holds a run, or a block of each run, however many rows a key has; what comes out goes on in frames of BLOCK rows."""

    RUN, BLOCK = 100_000, 2_000
    OUTPUT = ""

    def init(self, handle) -> None:
        self._handle = handle
        # The first block that is left of a run lies with it, so a key of few rows has one entry.
        self._runs = handle.getMapState("runs", "run long", "next long, blocks long, rows binary")
        self._blocks = handle.getMapState("blocks", "run long, block long", "rows binary")
        self.open(handle)

    def open(self, handle) -> None:
        raise NotImplementedError

    def settle(self, key, rows: Iterator[tuple]) -> Iterator[tuple]:
        """The output of rows (us, id, job, kind) in ascending order, none of them late; times in microseconds."""
        raise NotImplementedError

    def stale(self, now: int) -> int | None:
        """Drops what is old at the time now; the time, in microseconds, at which to look again."""
        raise NotImplementedError

    def _wake(self, us: int) -> None:
        self._handle.registerTimer(-(-us // 1000))

    def _hold(self, run: int, rows: list[tuple]) -> int:
        """Puts rows into the state as a run; the first one's time."""
        rows.sort(key=_place)
        blocks = [pickle.dumps(rows[k : k + self.BLOCK]) for k in range(0, len(rows), self.BLOCK)]
        for k, block in enumerate(blocks[1:], 1):
            self._blocks.updateValue((run, k), (block,))
        self._runs.updateValue((run,), (1, len(blocks), blocks[0]))
        return rows[0][0]

    def _taken(self, run: int, at: int, blocks: int, packed: bytes, now: int, left: list[int]) -> Iterator[tuple]:
        """The rows of a run up to now, which leave the state as they are read; the time of its next row goes to left."""
        began = at
        while True:
            rows = pickle.loads(packed)
            ready = bisect_right(rows, now, key=lambda r: r[0])
            yield from rows[:ready]
            if ready < len(rows):
                if ready or at > began:
                    self._runs.updateValue((run,), (at, blocks, pickle.dumps(rows[ready:])))
                left.append(rows[ready][0])
                return
            if at == blocks:
                self._runs.removeKey((run,))
                return
            packed = self._blocks.getValue((run, at))[0]
            self._blocks.removeKey((run, at))
            at += 1

    def _frame(self, rows: list[tuple]):
        import pandas as pd

        names = [c.split() for c in self.OUTPUT.split(", ")]
        return pd.DataFrame({
            name: pd.to_datetime(pd.Series(values, dtype="int64"), unit="us", utc=True) if kind == "timestamp" else pd.Series(values, dtype=object)
            for (name, kind), values in zip(names, zip(*rows, strict=True), strict=True)
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        late, run, first, new = 1000 * timerValues.getCurrentWatermarkInMs(), None, [], []

        def hold() -> None:
            nonlocal run, new
            run = max((k[0] for k in self._runs.keys()), default=-1) + 1 if run is None else run + 1
            first.append(self._hold(run, new))
            new = []

        for frame in rows:
            for us, number, job, kind in zip(frame["us"].tolist(), *(frame[c] for c in ("id", "job", "kind")), strict=True):
                if us > late:
                    new.append((us, None if number is None else int(number), job, kind))
                    if len(new) == self.RUN:
                        hold()
        if new:
            hold()
        if first:
            self._wake(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now, left = 1000 * timerValues.getCurrentWatermarkInMs(), []
        runs = [self._taken(k[0], *v, now, left) for k, v in list(self._runs.iterator())]
        rows = heapq.merge(*runs, key=_place)
        one = next(rows, None)
        if one is not None:
            out = iter(self.settle(key, chain([one], rows)))
            while part := list(islice(out, self.BLOCK)):
                yield self._frame(part)
        if left:
            self._wake(min(left))
        later = self.stale(now)
        if later is not None:
            self._wake(max(later, now + 1000))

    def close(self) -> None:
        pass


class RateLimited(InOrder):
    """The twin of ``limits.rate_limited``: the key's times of the last span are its state."""

    OUTPUT = "key string, ts timestamp, id long, n_recent long, rejected boolean"

    def __init__(self, limit: int, seconds: int):
        self._limit, self._span = limit, seconds * _MICROS

    def open(self, handle) -> None:
        self._recent = handle.getListState("recent", "us long")

    def settle(self, key, rows):
        recent = [r[0] for r in self._recent.get()]
        for us, number, *_ in rows:
            recent = [t for t in recent if us - t < self._span] + [us]
            yield key[0], us, number, len(recent), len(recent) > self._limit
        self._recent.put([(t,) for t in recent])

    def stale(self, now):
        last = max((r[0] for r in self._recent.get()), default=None)
        if last is None:
            return None
        if now - last >= self._span:
            self._recent.clear()
            return None
        return last + self._span


class JobLog(InOrder):
    """The twin of ``jobs.job_events``: a key's events go to its job, which ends when it is idle for the time to live; the first
    events of a job are logged with numbers."""

    OUTPUT = "key string, ts timestamp, id long, started timestamp, seq long"

    def __init__(self, seconds: int, most: int):
        self._ttl, self._most = seconds * _MICROS, most

    def open(self, handle) -> None:
        self._job = handle.getValueState("job", "started long, last long, n long")

    def settle(self, key, rows):
        started, last, n = self._job.get() if self._job.exists() else (None, None, 0)
        for us, number, *_ in rows:
            if last is None or us - last >= self._ttl:
                started, n = us, 0
            if n < self._most:
                yield key[0], us, number, started, n
            last, n = us, n + 1
        self._job.update((started, last, n))

    def stale(self, now):
        if not self._job.exists():
            return None
        last = self._job.get()[1]
        if now - last >= self._ttl:
            self._job.clear()
            return None
        return last + self._ttl


class Capacity(InOrder):
    """The twin of ``jobs.job_table``: a scope's live jobs are its state, a map of a bounded number of entries."""

    OUTPUT = "key string, ts timestamp, id long, job string, outcome string, evicted string, live long"

    def __init__(self, most_jobs: int, most_events: int, seconds: int):
        self._most_jobs, self._most_events, self._ttl = most_jobs, most_events, seconds * _MICROS

    def open(self, handle) -> None:
        self._jobs = handle.getMapState("jobs", "job string", "place long, running boolean, updated long, n long")

    def _table(self) -> JobTable:
        return JobTable(self._most_jobs, self._most_events, self._ttl, {k[0]: tuple(v) for k, v in self._jobs.iterator()})

    def _keep(self, table: JobTable, before: set) -> None:
        for job in before - table.jobs.keys():
            self._jobs.removeKey((job,))
        for job, entry in table.jobs.items():
            self._jobs.updateValue((job,), entry)

    def settle(self, key, rows):
        table = self._table()
        before = set(table.jobs)
        for us, number, job, kind in rows:
            outcome, evicted = table.take(us, job, kind)
            yield key[0], us, number, job, outcome, evicted, len(table.jobs)
        self._keep(table, before)

    def stale(self, now):
        table = self._table()
        before = set(table.jobs)
        table.expire(now)
        self._keep(table, before)
        return min((v[2] for v in table.jobs.values()), default=None) + self._ttl + 1 if table.jobs else None


def _run(stream: DataFrame, processor: InOrder, watermark: str) -> DataFrame:
    """stream: (key string, ts timestamp, id long, job string, kind string)"""
    within = [F.timestamp_micros(F.lit(t)) for t in (_FIRST, _LAST)]
    rows = stream.filter("ts IS NOT NULL").select("key", F.least(F.greatest("ts", within[0]), within[1]).alias("ts"), F.unix_micros("ts").alias("us"), F.col("id").cast("string").alias("id"), "job", "kind")
    # By frames, as rows that come out would be held until a task is through.
    return rows.withWatermark("ts", watermark).groupBy("key").transformWithStateInPandas(processor, processor.OUTPUT, "Append", "EventTime")


def _plain(stream: DataFrame) -> DataFrame:
    return stream.select("key", "ts", "id", F.lit(None).cast("string").alias("job"), F.lit(None).cast("string").alias("kind"))


def rate_limited_stream(stream: DataFrame, limit: int = 5, seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """stream (key string, ts timestamp, id long): (key, ts, id, n_recent, rejected)."""
    return _run(_plain(stream), RateLimited(limit, seconds), watermark)


def job_events_stream(stream: DataFrame, seconds: int = TTL_SECONDS, most: int = MAX_EVENTS, watermark: str = "10 minutes") -> DataFrame:
    """stream (key string, ts timestamp, id long): (key, ts, id, started, seq)."""
    return _run(_plain(stream), JobLog(seconds, most), watermark)


def job_table_stream(stream: DataFrame, most_jobs: int = MAX_JOBS, most_events: int = MAX_EVENTS, seconds: int = TTL_SECONDS, watermark: str = "10 minutes") -> DataFrame:
    """stream (key string, the scope; ts timestamp; id long; job string; kind: start, event, done or error): (key, ts, id, job, outcome, evicted, live)."""
    return _run(stream.select("key", "ts", "id", "job", "kind"), Capacity(most_jobs, most_events, seconds), watermark)


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside spark whose state store is RocksDB; spark's own settings stay."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def replayed(spark: SparkSession, rows: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Runs a stream of a ``stateful_session`` over all that its sources have now, and returns what came out, as a table of spark's. A folder that is
    given keeps the progress, so that a later call goes on where this one stopped; without one it is a new one."""
    folder = folder or f"{shared_folder(spark)}/glyphmill/{name}"
    sink = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")
