"""Queries of what reports let one say, over the sub-criteria that lineitem carries (see score_queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import numbers
from glyphmill.operators import reading, scoring
from glyphmill.plans.registry import query
from glyphmill.plans.score_queries import _DIMENSIONS, _STATUS, _WEIGHT, _subs

# What could not be looked at is for three reasons in turn, so that all of them show.
_REASON = "CASE WHEN reason = 'LIMITED' THEN CASE ord % 3 WHEN 0 THEN 'EXTERNAL_NOT_READ' WHEN 1 THEN 'NOT_LOOKED' ELSE 'UNREADABLE' END ELSE reason END"
_SURE = f"""
  SELECT *, CASE certainty WHEN 'notEvaluated' THEN coalesce(own, 'rsExcluded') WHEN 'scope' THEN own WHEN 'absent' THEN own WHEN 'notDemonstrated' THEN 'rsObservable' END AS why FROM (
  SELECT *, CASE reason {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in reading.REASON_KEYS.items())} END AS own FROM (
  SELECT site_id, dimension, criterion, ord, {_REASON} AS reason, CASE status WHEN 'FOUND' THEN 'demonstrated' WHEN 'PARTIAL' THEN 'partial' WHEN 'ABSENT' THEN 'absent' WHEN 'OUT_OF_SCOPE' THEN 'scope'
    WHEN 'NOT_APPLICABLE' THEN 'na' WHEN 'NOT_EVALUABLE' THEN 'notEvaluated' ELSE 'notDemonstrated' END AS certainty, coalesce((most - points) / base * {_WEIGHT}, 0) AS loss
  FROM (SELECT *, sum(CASE WHEN points IS NOT NULL THEN most END) OVER (PARTITION BY site_id, dimension) AS base FROM ({_STATUS}))))"""
_TOP = len(numbers.LEVELS) - 1
_RANK = "CASE " + " ".join(f"WHEN floor(score + 0.5) >= {start} THEN {k}" for k, (start, _) in reversed(list(enumerate(numbers.LEVELS)))) + " END"
_READ = f"""
  SELECT *, CASE WHEN rank = {_TOP} AND gaps = 0 THEN 'full' WHEN rank = {_TOP} THEN 'high' WHEN rank = {_TOP - 1} THEN 'mid' ELSE 'low' END AS meaning FROM (
  SELECT d.site_id, d.dimension, d.score, {_RANK} AS rank, g.gaps, coalesce(g.incomplete, false) AS incomplete FROM ({_DIMENSIONS}) d LEFT JOIN (
    SELECT site_id, dimension, count(*) FILTER (WHERE certainty IN ('partial', 'notDemonstrated', 'absent')) AS gaps, bool_or(certainty IN ('notDemonstrated', 'notEvaluated', 'partial')) AS incomplete
    FROM ({_SURE}) GROUP BY 1, 2) g USING (site_id, dimension))"""
_TOTALS = f"""
  SELECT *, coalesce(d1 < 25, false) AND raw > 40 AS capped, CASE WHEN d1 IS NULL THEN 'INSUFFICIENT_D1' WHEN share < 0.5 - 1e-9 OR weight < 0.5 - 1e-9 THEN 'LOW_COVERAGE' ELSE 'SUFFICIENT' END AS sufficiency
  FROM (SELECT site_id, sum(score * w) / sum(CASE WHEN score IS NOT NULL THEN w END) AS raw, coalesce(sum(CASE WHEN score IS NOT NULL THEN w END), 0) AS weight,
    sum(w * share) AS share, max(CASE WHEN dimension = 'D1' THEN score END) AS d1 FROM (SELECT *, {_WEIGHT} AS w FROM ({_DIMENSIONS})) GROUP BY 1)"""
_LIMITED = "site_id % 4 = 0"


def _sure(spark, sf):
    subs = _subs(spark, sf)
    return subs, reading.reason_key(scoring.certainty(subs.withColumn("reason", F.expr(_REASON)), False), "live", False)


def _sites(subs):
    cover = F.struct(F.lit(4).alias("components_detected"), F.when(F.col("site_id") % 5 == 0, 3).otherwise(4).alias("components_evaluated"), F.expr(_LIMITED).alias("crawl_limited"))
    bad = F.when(F.col("site_id") % 3 == 0, F.array(F.lit(1), F.lit(2)))
    return subs.select("site_id").distinct().select("site_id", cover.alias("coverage"), bad.alias("contradictions"))


@query("K27_dimensions_read", f"SELECT site_id, dimension, rank, meaning, incomplete FROM ({_READ})")
def dimensions_read(spark, sf):
    subs, sure = _sure(spark, sf)
    return reading.dimensions_read(sure, scoring.dimension_scores(subs)).select("site_id", "dimension", "rank", "meaning", "incomplete")


def _agg(test: str, what: str = "dimension", order: str = "dimension") -> str:
    return f"coalesce(string_agg({what}, ',' ORDER BY {order}) FILTER (WHERE {test}), '')"


@query("K29_capability_lists", f"""
  WITH r AS ({_READ}), s AS ({_SURE}),
  w AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY loss DESC, ord) AS n FROM s JOIN (SELECT site_id, dimension FROM r WHERE rank >= {_TOP - 1}) USING (site_id, dimension) WHERE certainty IN ('partial', 'notDemonstrated', 'absent')),
  i AS (SELECT site_id, string_agg(criterion, ',' ORDER BY n) AS may_infer FROM w WHERE n <= {reading.MAX_INFER} GROUP BY 1)
  SELECT site_id, can, cannot, not_demonstrated, CASE WHEN none = '' THEN 'D7' ELSE none || ',D7' END AS not_evaluated, coalesce(may_infer, '') AS may_infer FROM (
    SELECT site_id, {_agg(f"rank = {_TOP}")} AS can, {_agg(f"rank <= {_TOP - 2} AND NOT incomplete")} AS cannot, {_agg(f"rank <= {_TOP - 2} AND incomplete")} AS not_demonstrated, {_agg("rank IS NULL")} AS none FROM r GROUP BY 1)
  LEFT JOIN i USING (site_id)""")
def capability_lists(spark, sf):
    subs, sure = _sure(spark, sf)
    found = reading.capabilities(sure, reading.dimensions_read(sure, scoring.dimension_scores(subs)))
    return found.select("site_id", *[F.array_join(c, ",").alias(c) for c in ("can", "cannot", "not_demonstrated", "not_evaluated", "may_infer")])


@query("K30_recommended_criteria", f"""
  SELECT site_id, dimension, {_agg("certainty = 'notEvaluated' AND coalesce(why, '') <> 'rsExcluded'", "criterion", "loss DESC, ord")} AS limits,
    {_agg("certainty = 'absent'", "criterion", "loss DESC, ord")} AS direct, {_agg("certainty IN ('notDemonstrated', 'partial')", "criterion", "loss DESC, ord")} AS possible FROM ({_SURE}) GROUP BY 1, 2""")
def recommended(spark, sf):
    return reading.recommendations(_sure(spark, sf)[1]).select("site_id", "dimension", *[F.array_join(c, ",").alias(c) for c in ("limits", "direct", "possible")])


@query("K28_incomplete_reasons", f"""
  WITH w AS (SELECT site_id, bool_or(why = 'rsExternal') AS ext, bool_or(why IN ('rsNotLooked', 'rsNotRead')) AS looked, bool_or(why = 'rsUnreadable') AS unread FROM ({_SURE}) GROUP BY 1),
  n AS (SELECT site_id, string_agg(dimension, ',' ORDER BY dimension) FILTER (WHERE score IS NULL) AS none FROM ({_DIMENSIONS}) GROUP BY 1)
  SELECT site_id, concat_ws(';', CASE WHEN {_LIMITED} THEN 'LIMITED' END, CASE WHEN capped THEN 'GATE' END, CASE WHEN ext THEN 'EXTERNAL' END, CASE WHEN looked THEN 'NOT_LOOKED' END, CASE WHEN unread THEN 'UNREADABLE' END,
    CASE WHEN sufficiency = 'LOW_COVERAGE' THEN 'LOW_COVERAGE:' || CAST(floor(share * 100 + 0.5) AS BIGINT) END, CASE WHEN none IS NOT NULL THEN 'NOT_EVALUATED:' || none END) AS reasons
  FROM ({_TOTALS}) JOIN w USING (site_id) JOIN n USING (site_id)""")
def incomplete(spark, sf):
    subs, sure = _sure(spark, sf)
    dims = scoring.dimension_scores(subs)
    found = reading.incomplete_reasons(_sites(subs), scoring.global_scores(dims), sure, reading.dimensions_read(sure, dims))
    return found.select("site_id", F.array_join("reasons", ";").alias("reasons"))


@query("K24_limitation_codes", f"""
  WITH m AS (SELECT site_id, dimension, string_agg(criterion, ',' ORDER BY ord) AS names FROM ({_STATUS}) WHERE status = 'NOT_EVALUABLE' GROUP BY 1, 2),
  d AS (SELECT site_id, string_agg(dimension || ':' || status || ':' || coalesce(names, ''), ';' ORDER BY dimension || ':' || status || ':' || coalesce(names, '')) FILTER (WHERE status IN ('PARTIAL', 'NOT_EVALUABLE')) AS dims FROM ({_DIMENSIONS}) LEFT JOIN m USING (site_id, dimension) GROUP BY 1)
  SELECT site_id, concat_ws(';', CASE WHEN site_id % 5 = 0 THEN 'PARTIAL' WHEN {_LIMITED} THEN 'LIMITED' END, dims, 'D7:NOT_EVALUATED', CASE WHEN sufficiency = 'INSUFFICIENT_D1' THEN sufficiency END,
    CASE WHEN sufficiency = 'LOW_COVERAGE' THEN 'LOW_COVERAGE:' || CAST(floor(share * 100 + 0.5) AS BIGINT) END, CASE WHEN site_id % 3 = 0 THEN 'CONTRADICTIONS:2' END) AS limitations
  FROM ({_TOTALS}) JOIN d USING (site_id)""")
def limitation_codes(spark, sf):
    subs, _ = _sure(spark, sf)
    dims, sites = scoring.dimension_scores(subs), _sites(subs)
    return reading.limitations(sites, scoring.global_scores(dims), dims, scoring.coverage_status(sites)).select("site_id", F.array_join("limitations", ";").alias("limitations"))
