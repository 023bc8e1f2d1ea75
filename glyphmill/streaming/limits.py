"""Operational limits over event tables. ``stateful`` has the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.relational import in_ranges

SLICE = 3600 * 1_000_000


def rate_limited(events: DataFrame, key: str, ts: str, tie: str, limit: int = 5, seconds: int = 60) -> DataFrame:
    """Adds n_recent, the key's events in the seconds before and up to this one (half-open: an event exactly that old is
    out), and rejected. Rejected events count too. Events of one time are in the order of tie.

    A key is cut in slices of time, with the end of each slice repeated in the next, so a hot key isn't one task."""
    span = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cut = events.withColumn("_at", at).withColumn("_slice", F.floor(F.col("_at") / SLICE))
    later = F.when(F.floor((F.col("_at") + span) / SLICE) > F.col("_slice"), F.array(F.col("_slice"), F.col("_slice") + 1)).otherwise(F.array("_slice"))
    spread = cut.select("*", F.explode(later).alias("_in"))
    w = Window.partitionBy(key, "_in").orderBy("_at")
    upto = F.count("*").over(w.rangeBetween(-(span - 1), 0))
    peers = Window.partitionBy(key, "_in", "_at")
    after = F.count("*").over(peers) - F.row_number().over(peers.orderBy(tie))
    out = spread.withColumn("n_recent", (upto - after).cast("long")).filter("_in = _slice")
    return out.withColumn("rejected", F.col("n_recent") > limit).drop("_at", "_slice", "_in")


def evicted(events: DataFrame, key: str, ts: str, now: str, seconds: int) -> DataFrame:
    """(key, last_seen) of the keys whose last event is at least seconds before now, a column of the events."""
    last = events.groupBy(key).agg(F.max(ts).alias("last_seen"), F.max(now).alias("_now"))
    gone = F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp")) >= seconds * 1_000_000
    return last.filter(gone).drop("_now")


def running(starts: DataFrame, day: str, ts: str, delta: str, tie: str) -> DataFrame:
    """Adds active: the sum of +1 and -1 so far within a day."""
    return in_ranges(starts, [day], [ts, tie], delta).withColumnRenamed("_sofar", "active").drop("_size")


def job_log(events: DataFrame, job: str, order: list, cap: int = 200, since: int = 0) -> DataFrame:
    """Adds seq (from 0) and keeps the first cap events of each job from the offset on."""
    seq = F.row_number().over(Window.partitionBy(job).orderBy(*order)) - 1
    return events.withColumn("seq", seq.cast("long")).filter((F.col("seq") < cap) & (F.col("seq") >= since))


def sessions(events: DataFrame, key: str, ts: str, tie: str, seconds: int = 600) -> DataFrame:
    """Adds session (from 1): a gap of at least seconds since the key's last event ends one."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    new = F.when(gap.isNull() | (gap >= seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
