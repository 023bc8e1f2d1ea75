"""Jobs in batches: events of a job by its time to live, and a table of live jobs with a capacity. ``stateful`` has the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
TTL_SECONDS, MAX_JOBS, MAX_EVENTS = 600, 20, 200
STARTED, REFUSED, LOGGED, FULL, UNKNOWN, FINISHED = "started", "refused", "logged", "full", "unknown", "finished"


def job_events(events: DataFrame, key: str, ts: str, tie: str, seconds: int = TTL_SECONDS, most: int = MAX_EVENTS, since: int = 0) -> DataFrame:
    """Adds started, the time of the first event of a key's job, and seq, the event's number in the job from 0; a job ends when the key is idle for
    seconds. The first most events of a job stay, from number since on."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = F.col("_at") - F.lag("_at").over(w)
    opened = events.withColumn("_at", at).withColumn("_opens", F.when(gap.isNull() | (gap >= seconds * 1_000_000), F.col(ts)))
    job = opened.withColumn("started", F.last("_opens", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seq = F.row_number().over(Window.partitionBy(key, "started").orderBy(ts, tie)) - 1
    return job.withColumn("seq", seq.cast("long")).filter((F.col("seq") < most) & (F.col("seq") >= since)).drop("_at", "_opens")


class JobTable:
    """The live jobs of a scope: job -> (place, running, updated, events); place is the order of starts."""

    def __init__(self, most_jobs: int, most_events: int, ttl: int, jobs: dict[str, tuple] | None = None):
        self.jobs = jobs or {}
        self._most_jobs, self._most_events, self._ttl = most_jobs, most_events, ttl
        self._next = max((v[0] for v in self.jobs.values()), default=-1) + 1

    def expire(self, now: int) -> None:
        """Drops the jobs that have been idle for longer than their time to live."""
        self.jobs = {k: v for k, v in self.jobs.items() if now - v[2] <= self._ttl}

    def take(self, now: int, job: str, kind: str) -> tuple[str, str | None]:
        """(outcome, job that had to go) of an event at a time in microseconds; kind is start, event, done or error."""
        self.expire(now)
        place, _, _, n = self.jobs.get(job, (None, None, None, 0))
        if kind == "start":
            return (REFUSED, None) if place is not None else (STARTED, self._start(now, job))
        if place is None:
            return UNKNOWN, None
        if kind == "event":
            if n >= self._most_events:
                return FULL, None
            self.jobs[job] = (place, self.jobs[job][1], now, n + 1)
            return LOGGED, None
        self.jobs[job] = (place, False, now, n)
        return FINISHED, None

    def _start(self, now: int, job: str) -> str | None:
        victim = None
        if len(self.jobs) >= self._most_jobs:
            # The oldest that has ended, or else the oldest of all.
            victim = min(self.jobs, key=lambda k: (self.jobs[k][1], self.jobs[k][0]))
            del self.jobs[victim]
        self.jobs[job] = (self._next, True, now, 0)
        self._next += 1
        return victim


def job_table(events: DataFrame, scope: str, ts: str, tie: str, job: str, kind: str, most_jobs: int = MAX_JOBS, most_events: int = MAX_EVENTS, seconds: int = TTL_SECONDS) -> DataFrame:
    """(scope, tie, job, outcome, evicted, live) of all events in their order. What an event does depends on all before it in its scope, so a scope's
    events go by one task in order, which holds its live jobs alone, most_jobs at most."""
    rows = events.select(F.col(scope).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(tie).alias("id"), F.col(job).cast("string").alias("job"), F.col(kind).alias("kind"))
    rows = rows.filter("us IS NOT NULL").repartition("key").sortWithinPartitions("key", "us", "id")

    def run(batches):
        import pyarrow as pa

        table, own = None, None
        for batch in batches:
            out = []
            for key, us, number, name, what in zip(*(batch.column(c).to_pylist() for c in ("key", "us", "id", "job", "kind")), strict=True):
                if table is None or key != own:
                    table, own = JobTable(most_jobs, most_events, seconds * 1_000_000), key
                outcome, evicted = table.take(us, name, what)
                out.append((key, number, name, outcome, evicted, len(table.jobs)))
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=["key", "id", "job", "outcome", "evicted", "live"])

    return rows.mapInArrow(run, "key string, id long, job string, outcome string, evicted string, live long")
