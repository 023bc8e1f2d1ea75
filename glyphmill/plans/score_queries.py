"""Queries of the scoring layer on many sites: sub-criteria carried by lineitem, a supplier as a site."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import detectors, scoring
from glyphmill.plans.registry import query

#: Sub-criteria in SQL: points (a quarter of the maximum at a time, or null), whether they apply, and what overrides them.
_SUBS = """
  SELECT l_suppkey AS site_id, 'D' || (1 + l_partkey % 6) AS dimension, 'c' || l_orderkey || '.' || l_linenumber AS criterion, l_orderkey * 10 + l_linenumber AS ord,
    CASE WHEN CAST(l_quantity AS BIGINT) % 7 <> 0 THEN (CAST(l_quantity AS BIGINT) % 5) * (10 + 5 * (l_linenumber % 4)) / 4.0 END::DOUBLE AS given,
    (10 + 5 * (l_linenumber % 4))::DOUBLE AS most, l_orderkey % 3 <> 0 AS applicable,
    CASE l_partkey % 11 WHEN 0 THEN 'OUT_OF_SCOPE' WHEN 1 THEN 'NOT_EVALUABLE' WHEN 2 THEN 'ABSENT' END AS over_status, CASE WHEN l_partkey % 11 = 1 THEN 'LIMITED' END AS over_reason
  FROM lineitem"""
_STATUS = f"""
  SELECT *, CASE WHEN over_status IN ('OUT_OF_SCOPE', 'NOT_EVALUABLE') THEN NULL ELSE given END AS points,
    CASE WHEN over_status IN ('OUT_OF_SCOPE', 'NOT_EVALUABLE') THEN over_status WHEN given IS NULL THEN CASE WHEN applicable THEN 'NOT_EVALUABLE' ELSE 'NOT_APPLICABLE' END
      WHEN given >= most THEN 'FOUND' WHEN given > 0 THEN 'PARTIAL' WHEN over_status = 'ABSENT' THEN 'ABSENT' ELSE 'NOT_FOUND' END AS status,
    coalesce(over_reason, CASE WHEN given IS NULL THEN CASE WHEN applicable THEN 'NO_BASIS' ELSE 'NOT_APPLICABLE' END END) AS reason FROM ({_SUBS})"""
_DIMENSIONS = f"""
  SELECT site_id, dimension, sum(points) / sum(CASE WHEN points IS NOT NULL THEN most END) * 100 AS score,
    coalesce(sum(CASE WHEN points IS NOT NULL THEN most END) / sum(CASE WHEN status <> 'OUT_OF_SCOPE' THEN most END), 0) AS share,
    CASE WHEN count(points) = 0 THEN 'NOT_EVALUABLE' WHEN count(*) FILTER (WHERE status = 'NOT_EVALUABLE') > 0 THEN 'PARTIAL' ELSE 'EVALUATED' END AS status,
    count(*) FILTER (WHERE status = 'NOT_EVALUABLE') AS missing FROM ({_STATUS}) GROUP BY 1, 2"""
_WEIGHT = "CASE dimension WHEN 'D1' THEN 0.20 WHEN 'D2' THEN 0.15 WHEN 'D3' THEN 0.20 WHEN 'D4' THEN 0.25 WHEN 'D5' THEN 0.10 WHEN 'D6' THEN 0.10 END::DOUBLE"


def _subs(spark, sf):
    i = spark.read.parquet(f"{sf}/lineitem.parquet")
    most = (10 + 5 * (i.l_linenumber % 4)).cast("double")
    kind = i.l_partkey % 11
    over = F.when(kind == 0, "OUT_OF_SCOPE").when(kind == 1, "NOT_EVALUABLE").when(kind == 2, "ABSENT")
    given = F.when(i.l_quantity.cast("long") % 7 != 0, (i.l_quantity.cast("long") % 5) * most / 4)
    rows = i.select(
        i.l_suppkey.alias("site_id"), F.concat(F.lit("D"), (1 + i.l_partkey % 6).cast("string")).alias("dimension"),
        F.concat(F.lit("c"), i.l_orderkey.cast("string"), F.lit("."), i.l_linenumber.cast("string")).alias("criterion"),
        given.alias("points"), most.alias("max"), (i.l_orderkey % 3 != 0).alias("applicable"), (i.l_orderkey * 10 + i.l_linenumber).alias("ord"),
        F.struct(over.alias("status"), F.when(kind == 1, "LIMITED").alias("reason")).alias("over"),
    )
    return scoring.with_status(rows)


@query("C09_K07_criteria_status", f"SELECT site_id, criterion, points, status, reason FROM ({_STATUS})")
def criteria_status(spark, sf):
    return _subs(spark, sf).select("site_id", "criterion", "points", "status", "reason")


@query("K19_dimension_scores", f"SELECT site_id, dimension, round(score, 6) AS score, round(share, 6) AS share, status, missing FROM ({_DIMENSIONS})")
def dimension_scores(spark, sf):
    d = scoring.dimension_scores(_subs(spark, sf))
    return d.select("site_id", "dimension", F.round("score", 6).alias("score"), F.round("share", 6).alias("share"), "status", F.size("missing").cast("long").alias("missing"))


@query("K20_D15_D16_global_score", f"""
  SELECT site_id, round(raw, 6) AS raw, round(CASE WHEN d1 < 25 THEN least(raw, 40) ELSE raw END, 6) AS score, coalesce(d1 < 25, false) AS gated, round(share, 6) AS share,
    CASE WHEN d1 IS NULL THEN 'INSUFFICIENT_D1' WHEN share < 0.5 - 1e-9 OR weight < 0.5 - 1e-9 THEN 'LOW_COVERAGE' ELSE 'SUFFICIENT' END AS sufficiency
  FROM (SELECT site_id, sum(score * w) / sum(CASE WHEN score IS NOT NULL THEN w END) AS raw, coalesce(sum(CASE WHEN score IS NOT NULL THEN w END), 0) AS weight,
    sum(w * share) AS share, max(CASE WHEN dimension = 'D1' THEN score END) AS d1 FROM (SELECT *, {_WEIGHT} AS w FROM ({_DIMENSIONS})) GROUP BY 1)""")
def global_score(spark, sf):
    g = scoring.global_scores(scoring.dimension_scores(_subs(spark, sf)))
    return g.select("site_id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"), "gated", F.round("share", 6).alias("share"), "sufficiency")


@query("K26_certainty", f"""
  SELECT site_id, criterion, CASE status WHEN 'FOUND' THEN 'demonstrated' WHEN 'PARTIAL' THEN 'partial' WHEN 'ABSENT' THEN 'absent' WHEN 'OUT_OF_SCOPE' THEN 'scope'
    WHEN 'NOT_APPLICABLE' THEN 'na' WHEN 'NOT_EVALUABLE' THEN 'notEvaluated' ELSE 'notDemonstrated' END AS certainty,
    round(coalesce((most - points) / base * {_WEIGHT}, 0), 9) AS loss
  FROM (SELECT *, sum(CASE WHEN points IS NOT NULL THEN most END) OVER (PARTITION BY site_id, dimension) AS base FROM ({_STATUS}))""")
def certainty(spark, sf):
    return scoring.certainty(_subs(spark, sf), False).select("site_id", "criterion", "certainty", F.round("loss", 9).alias("loss"))


@query("K23_diagnosis", f"""
  SELECT site_id, dimension, coalesce(string_agg(criterion, ',' ORDER BY ord) FILTER (WHERE status = 'FOUND'), '') AS works,
    coalesce(string_agg(criterion, ',' ORDER BY ord) FILTER (WHERE status IN ('PARTIAL', 'NOT_FOUND', 'ABSENT')), '') AS gaps,
    coalesce(string_agg(criterion, ',' ORDER BY ord) FILTER (WHERE status IN ('NOT_EVALUABLE', 'NOT_APPLICABLE', 'OUT_OF_SCOPE')), '') AS excluded FROM ({_STATUS}) GROUP BY 1, 2""")
def diagnosis(spark, sf):
    return scoring.diagnosis(_subs(spark, sf)).select("site_id", "dimension", *[F.array_join(c, ",").alias(c) for c in ("works", "gaps", "excluded")])


@query("K21_D19_coverage_status", """
  WITH c AS (SELECT c_custkey AS site_id, c_custkey % 5 AS found, least(c_custkey % 5, c_custkey % 4) AS seen, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 3 = 0 END AS cut FROM customer)
  SELECT site_id, CASE WHEN found > 0 THEN seen / found END::DOUBLE AS ratio, CASE WHEN found > 0 AND seen < found THEN 'PARTIAL' WHEN cut THEN 'LIMITED' ELSE 'COMPLETE' END AS status FROM c""")
def coverage_status(spark, sf):
    k = F.col("c_custkey")
    cells = F.struct((k % 5).alias("components_detected"), F.least(k % 5, k % 4).alias("components_evaluated"), F.when(k % 7 > 0, k % 3 == 0).alias("crawl_limited"))
    return scoring.coverage_status(spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("site_id"), cells.alias("coverage")))


_TOKEN = "'n' || (p_partkey % 60) || '.' || p_size % 3"


@query("K02_G01_G02_tokens", f"""
  WITH p AS (SELECT p_brand AS site_id, p_partkey AS k, {_TOKEN} AS name, 'u' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS url, p_type AS value, CASE WHEN p_size % 4 = 0 THEN p_name END AS intent FROM part),
  told AS (SELECT site_id, name, arg_min(intent, url) AS intent FROM p WHERE intent IS NOT NULL GROUP BY 1, 2),
  j AS (SELECT site_id, name, 'v' || k AS value, told.intent, 'json' AS origin, 'https://ds.com/' || k || '.json' AS source, 0.8::DOUBLE AS confidence FROM p LEFT JOIN told USING (site_id, name) WHERE k % 3 = 0),
  h AS (SELECT *, row_number() OVER (PARTITION BY site_id, name ORDER BY url) AS n FROM p WHERE (site_id, name) NOT IN (SELECT (site_id, name) FROM j))
  SELECT * FROM j UNION ALL SELECT site_id, name, value, intent, 'html_table', url, 0.6::DOUBLE FROM h WHERE n = 1""")
def tokens(spark, sf):
    """Every part as a row of a token table of its brand, and every third as a file of one token besides."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("site_id"), F.col("p_partkey").alias("id"), F.expr(_TOKEN).alias("name"), F.col("p_type").alias("value"), F.expr("CASE WHEN p_size % 4 = 0 THEN p_name END").alias("intent"))
    row = F.struct("name", "value", "intent")
    seen = p.select("site_id", F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("url"), F.struct(F.array(row).alias("tokens")).alias("f"))
    body = F.expr("""'{"' || replace(name, '.', '":{"') || '":"v' || id || '"}}'""")
    files = p.filter("id % 3 = 0").select("id", "site_id", F.concat(F.lit("https://ds.com/"), "id", F.lit(".json")).alias("url"), body.alias("body"))
    return detectors.tokens(seen, files).select("site_id", "name", "value", "intent", "origin", "source", "confidence")
