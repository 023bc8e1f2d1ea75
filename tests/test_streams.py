"""Streams give the rows of their batch twins, whatever the order of arrival, and after a restart."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glyphmill.streaming import jobs, limits, stateful

BEGIN = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "key string, ts timestamp, id long, job string, kind string"


@pytest.fixture(scope="module")
def events():
    rng = random.Random(1)
    rows, at = [], 0
    for k in range(600):
        at += rng.choice([0, 1, 3, 20, 200])
        ts = BEGIN + timedelta(seconds=at, microseconds=rng.choice([0, 1, 999_999]))
        rows.append((rng.choice(["a", "b", None]), ts, k, f"j{rng.randrange(9)}", rng.choice(["start", "start", "event", "event", "done", "error"])))
    # The watermark passes all of these once an event of another key is far ahead.
    return rows, ("end", rows[-1][1] + timedelta(days=1), 10_000, "j0", "start")


def streamed(spark, tmp_path, events, make, files):
    """What make(stream) gives for events that come in files, a run of the query for each."""
    rows, end = events
    rng, folder, out = random.Random(2), tmp_path / "in", None
    # Rows come late by less than the watermark's delay, so none is dropped.
    order = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(500)))
    parts = [order[k * len(order) // files : (k + 1) * len(order) // files] for k in range(files)]
    own = stateful.stateful_session(spark)
    for part in [*parts, [end], [(*end[:2], 10_001, *end[3:])]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        out = stateful.replayed(spark, make(own.readStream.schema(SCHEMA).parquet(str(folder))), "test", f"file://{tmp_path}/out")
    return [tuple(r) for r in out.filter(F.col("key").isNull() | (F.col("key") != "end")).collect()]


def test_rate_limit(spark, tmp_path, events):
    got = streamed(spark, tmp_path, events, lambda s: stateful.rate_limited_stream(s, 3, 60), 3)
    batch = limits.rate_limited(spark.createDataFrame(events[0], SCHEMA), "key", "ts", "id", 3, 60).select("key", "ts", "id", "n_recent", "rejected")
    want = [tuple(r) for r in batch.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[4] for r in want)


def test_job_events(spark, tmp_path, events):
    got = streamed(spark, tmp_path, events, lambda s: stateful.job_events_stream(s, 120, 7), 2)
    batch = jobs.job_events(spark.createDataFrame(events[0], SCHEMA), "key", "ts", "id", 120, 7).select("key", "ts", "id", "started", "seq")
    assert sorted(got, key=str) == sorted((tuple(r) for r in batch.collect()), key=str)


def plain_table(rows, most_jobs, most_events, seconds):
    """The rules by themselves: a list of jobs in order of their starts, for each scope."""
    scopes, out = {}, []
    for key, ts, number, job, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        live = [j for j in scopes.get(key, []) if (ts - j["updated"]) <= timedelta(seconds=seconds)]
        known, outcome, evicted = next((j for j in live if j["job"] == job), None), "unknown", None
        if kind == "start":
            outcome = "refused" if known else "started"
            if not known:
                if len(live) >= most_jobs:
                    gone = next((j for j in live if j["ended"]), live[0])
                    evicted = gone["job"]
                    live.remove(gone)
                live.append({"job": job, "updated": ts, "ended": False, "n": 0})
        elif known and kind == "event":
            outcome = "full" if known["n"] >= most_events else "logged"
            if outcome == "logged":
                known["n"], known["updated"] = known["n"] + 1, ts
        elif known:
            outcome, known["ended"], known["updated"] = "finished", True, ts
        scopes[key] = live
        out.append((key, number, job, outcome, evicted, len(live)))
    return out


def test_job_table(spark, tmp_path, events):
    frame = spark.createDataFrame(events[0], SCHEMA)
    want = plain_table(events[0], 4, 1, 900)
    assert {w[3] for w in want} == {"started", "refused", "logged", "full", "unknown", "finished"} and any(w[4] for w in want)
    batch = jobs.job_table(frame, "key", "ts", "id", "job", "kind", 4, 1, 900)
    assert sorted(map(tuple, batch.collect()), key=str) == sorted(want, key=str)
    got = streamed(spark, tmp_path, events, lambda s: stateful.job_table_stream(s, 4, 1, 900), 3)
    assert sorted(((r[0], *r[2:]) for r in got), key=str) == sorted(want, key=str)


def test_long_keys_wait_as_runs(spark, tmp_path, events):
    def make(stream):
        processor = stateful.Capacity(4, 1, 900)
        processor.RUN, processor.BLOCK = 50, 7
        return stateful._run(stream, processor, "10 minutes")

    got = streamed(spark, tmp_path, events, make, 2)
    assert sorted(((r[0], *r[2:]) for r in got), key=str) == sorted(plain_table(events[0], 4, 1, 900), key=str)


class Held(dict):
    """A map state, or the handle of some."""

    def getMapState(self, name, *_):
        return self.setdefault(name, Held())

    def getValue(self, key):
        return self[key]

    updateValue, removeKey, iterator = dict.__setitem__, dict.__delitem__, dict.items

    def registerTimer(self, ms):
        self["timer"] = ms


def test_settled_rows_come_by_blocks():
    import pandas as pd

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    handle, processor, n = Held(), stateful.Capacity(4, 1, 900), 1000
    processor.RUN, processor.BLOCK = 100, 10
    processor.init(handle)
    rows = [(1000 * (k * 7919 % n + 1), str(k), "j", "start") for k in range(n)]
    frames = [pd.DataFrame(rows[k : k + 130], columns=["us", "id", "job", "kind"]) for k in range(0, n, 130)]
    list(processor.handleInputRows(("a",), iter(frames), At(0)))
    assert len(handle["runs"]) == 10 and len(handle["blocks"]) == 90 and handle["timer"] == 1
    out = processor.handleExpiredTimer(("a",), At(600), None)
    first = next(out)
    # One frame is out, and all but the first blocks of each run are still in the state.
    assert len(first) == 10 and len(handle["blocks"]) >= 80
    ids = [*first["id"], *(i for frame in out for i in frame["id"])]
    assert ids == [int(r[1]) for r in sorted(rows)[:600]] and handle["timer"] > 600
    ids = [i for frame in processor.handleExpiredTimer(("a",), At(2000), None) for i in frame["id"]]
    assert ids == [int(r[1]) for r in sorted(rows)[600:]] and not handle["runs"] and not handle["blocks"]


def test_rows_without_time_or_id(spark, tmp_path, events):
    late = BEGIN + timedelta(seconds=5)
    rows = [("a", late, None, "j", "event"), ("a", late, 2**62 + 1, "j", "start"), ("a", datetime(1960, 1, 1, tzinfo=UTC), 4, "j", "start")]
    got = streamed(spark, tmp_path, (rows, events[1]), lambda s: stateful.job_table_stream(s.unionByName(s.filter("id IS NULL").withColumn("ts", F.lit(None).cast("timestamp"))), 4, 1, 900), 1)
    assert sorted(((r[0], *r[2:]) for r in got), key=str) == sorted([("a", None, "j", "unknown", None, 0), ("a", 2**62 + 1, "j", "started", None, 1)], key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert jobs.job_events(none, "key", "ts", "id").collect() == [] and jobs.job_table(none, "key", "ts", "id", "job", "kind").collect() == []


def test_evicted_keys(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:09:00"), ("b", "2024-01-01 00:10:00"), (None, "2024-01-01 00:00:00")]
    frame = spark.createDataFrame(rows, "key string, ts string").withColumn("now", F.lit("2024-01-01 00:19:00"))
    assert {r.key for r in limits.evicted(frame, "key", "ts", "now", 600).collect()} == {"a", None}
