"""Queries over events as jobs, in batches and as streams that are replayed over the table; a stream's rows are those that its watermark has settled."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.plans.registry import query
from glyphmill.streaming import jobs, stateful

_DAY, _DELAY_MS = 86_400, 3_600_000
_DELAY = f"{_DELAY_MS} milliseconds"
_SETTLED = f"epoch_us(ts) <= (SELECT (max(epoch_us(ts)) // 1000 - {_DELAY_MS}) * 1000 FROM events)"
#: The capacity query: events of 8 servers, jobs of users; a job lives two days without an event.
_SERVERS, _JOBS, _EVENTS, _TTL = 8, 5, 3, 2 * _DAY
_KIND = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'event' END"


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def _stream(spark, sf):
    """The table of events as a stream of a session with a state store, for each of the keys that streams ask for."""
    own = stateful.stateful_session(spark)
    rows = own.readStream.schema(_events(spark, sf).schema).parquet(f"{sf}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


_JOB_EVENTS = f"""
  WITH g AS (SELECT event_id, user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
  s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {_DAY} * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
  n AS (SELECT event_id, ts, epoch_us(first_value(ts) OVER w) AS started_us, row_number() OVER w - 1 AS seq FROM s WINDOW w AS (PARTITION BY user_id, session ORDER BY ts, event_id))
  SELECT event_id, started_us, seq FROM n WHERE seq < 5"""


@query("I05_I06_job_events", _JOB_EVENTS)
def job_events(spark, sf):
    found = jobs.job_events(_events(spark, sf), "user_id", "ts", "event_id", _DAY, 5)
    return found.select("event_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started_us"), "seq")


@query("I05_I06_job_events_stream", f"{_JOB_EVENTS} AND {_SETTLED}")
def job_events_stream(spark, sf):
    rows = _stream(spark, sf).select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("id"))
    found = stateful.replayed(spark, stateful.job_events_stream(rows, _DAY, 5, _DELAY), "job-events")
    return found.select(F.col("id").alias("event_id"), F.unix_micros("started").alias("started_us"), "seq")


@query("I01_I03_rate_limit_stream", f"""
  SELECT a.event_id, count(*) AS n_recent, count(*) > 5 AS rejected FROM (SELECT * FROM events WHERE {_SETTLED}) a JOIN events b ON a.user_id = b.user_id
   AND epoch_us(b.ts) > epoch_us(a.ts) - {_DAY}000000 AND (epoch_us(b.ts) < epoch_us(a.ts) OR (b.ts = a.ts AND b.event_id <= a.event_id)) GROUP BY 1""")
def rate_limit_stream(spark, sf):
    rows = _stream(spark, sf).select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("id"))
    found = stateful.replayed(spark, stateful.rate_limited_stream(rows, 5, _DAY, _DELAY), "rate-limit")
    return found.select(F.col("id").alias("event_id"), "n_recent", "rejected")


def _capacity_sql(where: str) -> str:
    entry = "{'job': e.job, 'us': e.us, 'running': true, 'n': 0}"
    return f"""
  WITH RECURSIVE e AS (
    SELECT event_id, CAST(user_id % {_SERVERS} AS VARCHAR) AS scope, CAST(user_id AS VARCHAR) AS job, epoch_us(ts) AS us, {_KIND} AS kind,
           row_number() OVER (PARTITION BY user_id % {_SERVERS} ORDER BY ts, event_id) AS k FROM events
  ), run AS (
    SELECT DISTINCT scope, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(job VARCHAR, us BIGINT, running BOOLEAN, n INTEGER)[]) AS jobs, CAST(NULL AS BIGINT) AS event_id,
           CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS evicted FROM e
    UNION ALL
    SELECT scope, k, CASE
        WHEN kind = 'start' AND known IS NOT NULL THEN live
        WHEN kind = 'start' THEN list_filter(live, lambda x: victim IS NULL OR x.job <> victim) || [CAST({entry} AS STRUCT(job VARCHAR, us BIGINT, running BOOLEAN, n INTEGER))]
        WHEN known IS NULL OR (kind = 'event' AND known.n >= {_EVENTS}) THEN live
        ELSE list_transform(live, lambda x: CASE WHEN x.job <> e.job THEN x
          ELSE {{'job': x.job, 'us': e.us, 'running': x.running AND kind = 'event', 'n': x.n + CASE WHEN kind = 'event' THEN 1 ELSE 0 END}} END) END AS jobs,
      event_id, CASE WHEN kind = 'start' THEN CASE WHEN known IS NULL THEN 'started' ELSE 'refused' END WHEN known IS NULL THEN 'unknown'
        WHEN kind <> 'event' THEN 'finished' WHEN known.n >= {_EVENTS} THEN 'full' ELSE 'logged' END AS outcome, victim AS evicted
    FROM (
      SELECT *, list_filter(live, lambda x: x.job = job)[1] AS known,
        CASE WHEN kind = 'start' AND list_filter(live, lambda x: x.job = job)[1] IS NULL AND len(live) >= {_JOBS}
             THEN coalesce(list_filter(live, lambda x: NOT x.running)[1].job, live[1].job) END AS victim
      FROM (SELECT e.*, list_filter(r.jobs, lambda x: e.us - x.us <= {_TTL}000000) AS live FROM run r JOIN e ON e.scope = r.scope AND e.k = r.k + 1)
    ) AS e
  )
  SELECT event_id, outcome, evicted, CAST(len(jobs) AS BIGINT) AS live FROM run WHERE k > 0 AND {where}"""


def _capacity(rows):
    return rows.select(F.col("id").alias("event_id"), "outcome", "evicted", "live")


@query("I06_job_capacity", _capacity_sql("true"))
def job_capacity(spark, sf):
    e = _events(spark, sf).select((F.col("user_id") % _SERVERS).alias("scope"), "ts", "event_id", "user_id", F.expr(_KIND).alias("kind"))
    return _capacity(jobs.job_table(e, "scope", "ts", "event_id", "user_id", "kind", _JOBS, _EVENTS, _TTL))


@query("I06_job_capacity_stream", _capacity_sql(f"event_id IN (SELECT event_id FROM events WHERE {_SETTLED})"))
def job_capacity_stream(spark, sf):
    rows = _stream(spark, sf).select(
        (F.col("user_id") % _SERVERS).cast("string").alias("key"), "ts", F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("job"), F.expr(_KIND).alias("kind")
    )
    return _capacity(stateful.replayed(spark, stateful.job_table_stream(rows, _JOBS, _EVENTS, _TTL, _DELAY), "job-capacity"))
