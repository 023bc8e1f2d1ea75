"""Queries that assemble, score and explain sites, and those on requests, budgets and frontiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import html_scan, requests, urls
from glyphmill.operators import detectors, frontier, reading, relational, scoring
from glyphmill.plans.page_queries import _d_host, _d_segments
from glyphmill.plans.registry import query
from glyphmill.sources import site_documents


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sites(spark, sf):
    """Every host of pages as a site; a page without html counts as one that failed."""
    p = _t(spark, sf, "pages").withColumn("site_id", urls.host(F.col("url"))).filter("site_id IS NOT NULL")
    failed = F.col("html").isNull()
    read = p.filter(~failed).select("site_id", "url", F.lit("text/html").alias("content_type"), F.col("html").alias("body"), F.lit(False).alias("rendered"))
    records = p.select("site_id", "url", F.when(failed, "FAILED").otherwise("CRAWLED").alias("status"))
    return detectors.sites(read, records, spark.createDataFrame([], "id long, site_id string, body string"))


@query("K06_K25_site_reports")
def site_reports(spark, sf):
    return scoring.report(_sites(spark, sf)).select("site_id", "raw", "score", "shown", "level", "sufficiency", "status", F.size("findings").alias("n_findings"))


def _read(spark, sf):
    sites = _sites(spark, sf)
    subs = scoring.sub_criteria(sites)
    dims = scoring.dimension_scores(subs)
    sure = reading.reason_key(scoring.certainty(subs, False), "live", False)
    return sites, dims, sure, reading.dimensions_read(sure, dims)


@query("K27_K29_capabilities")
def capabilities(spark, sf):
    _, _, sure, read = _read(spark, sf)
    return reading.capabilities(sure, read)


@query("K24_K28_limitations")
def limitations(spark, sf):
    sites, dims, sure, read = _read(spark, sf)
    totals = scoring.global_scores(dims)
    why = reading.incomplete_reasons(sites, totals, sure, read)
    return reading.limitations(sites, totals, dims, scoring.coverage_status(sites)).join(why, "site_id")


@query("K30_recommendations")
def recommendations(spark, sf):
    return reading.recommendations(_read(spark, sf)[2])


@query("A20_A21_exports")
def exports(spark, sf):
    return site_documents.exported(scoring.report(_sites(spark, sf)))


@query("B16_depth_limit", f"SELECT page_id, CASE WHEN len({_d_segments()}) > 2 THEN 'OUT_OF_SCOPE' ELSE 'PENDING' END AS status FROM pages")
def depth_limit(spark, sf):
    p = _t(spark, sf, "pages")
    return frontier.by_depth(p.select("page_id", F.size(urls.segments(p.url)).alias("depth")), 2).select("page_id", "status")


@query("B17_public_sources", "SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), ' ')[1:40], lambda h: left(h, 80)), '|') AS headings FROM documents")
def public_sources(spark, sf):
    d = _t(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("url"), F.lit("link").alias("role"), F.lit("READ").alias("status"), F.lit(None).cast("string").alias("reason"),
                    F.lit(None).cast("array<string>").alias("used_as"), F.split(F.coalesce("text", F.lit("")), " ").alias("headings"))
    return site_documents.public_sources(rows).select(F.col("url").alias("doc_id"), F.array_join("headings", "|").alias("headings"))


def _facts_sql() -> str:
    """One SELECT a kind of fact of the parts as components, in the order of the rows of a component."""
    name, said = "CAST(p_partkey AS VARCHAR)", "p_partkey % 7 <> 0"
    kinds = [
        ("'description'", "p_name", "'documentation'", "'description'", 0.6, said),
        ("'when_to_use'", "p_type", "'usage_guideline'", "'when_to_use'", 0.6, f"{said} AND p_size % 2 = 0"),
        ("'restriction[0]'", "'Never ' || p_name", "'restriction'", "'restrictions'", 0.6, f"{said} AND p_size % 3 = 0"),
        ("'restriction[1]'", "'Avoid ' || p_type", "'restriction'", "'restrictions'", 0.6, f"{said} AND p_size % 3 = 0"),
        ("'disambiguation[0]'", "'Use ' || p_brand", "'restriction'", "'disambiguation_rules'", 0.5, f"{said} AND p_size % 5 = 0"),
        ("'props > size'", "'{\"type\":\"' || p_type || '\",\"default\":null}'", "'prop'", "'props'", 0.7, f"{said} AND p_size % 2 = 1"),
        ("'variants'", "p_brand || ', ' || p_type", "'documentation'", "'variants'", 0.6, f"{said} AND p_size % 4 = 0"),
        ("'states'", "'hover'", "'documentation'", "'states'", 0.6, f"{said} AND p_size % 4 = 1"),
        ("'accessibility'", "NULL", "'accessibility'", "'accessibility'", 0.6, f"{said} AND p_size % 6 = 0"),
        ("'example[0]'", "NULL", "'code_example'", "'examples'", 0.8, f"{said} AND p_size % 3 > 0"), ("'example[1]'", "NULL", "'code_example'", "'examples'", 0.8, f"{said} AND p_size % 3 > 1"),
    ]
    rows = [
        f"SELECT p_partkey, p_brand AS site_id, {k} AS k, {name} || ' > ' || {loc} AS location, {content} AS content, {kind} AS type, {section} AS section, 'FOUND' AS status, {sure}::DOUBLE AS confidence FROM part WHERE {test}"
        for k, (loc, content, kind, section, sure, test) in enumerate(kinds)
    ]
    blank = "SELECT p_partkey, p_brand AS site_id, 0 AS k, NULL AS location, NULL AS content, 'documentation' AS type, NULL AS section, 'NOT_EVALUABLE' AS status, 0.4::DOUBLE AS confidence FROM part WHERE p_partkey % 7 = 0"
    number = "row_number() OVER (PARTITION BY site_id ORDER BY lpad(CAST(p_partkey AS VARCHAR), 12, '0'), k)"
    return f"""
  SELECT site_id, 'ev-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS id, CAST(p_partkey AS VARCHAR) AS component, location, content, type, section, status, confidence
  FROM (SELECT *, {number} AS n FROM ({' UNION ALL '.join(rows + [blank])}))"""


@query("E06_component_evidence", _facts_sql())
def component_evidence(spark, sf):
    """Parts as the components of a site for each brand."""
    p = _t(spark, sf, "part")
    when = lambda test, value: F.when(F.expr(test), value)
    prop = F.struct(F.lit("size").alias("name"), p.p_type.alias("type"), F.lit(None).alias("description"), F.array().alias("allowed_values"), F.lit(None).alias("default"))
    cells = {
        "name": p.p_partkey.cast("string"), "description": p.p_name, "evaluation_status": when("p_partkey % 7 = 0", F.lit("NOT_EVALUABLE")), "props": when("p_size % 2 = 1", F.array(prop)),
        "variants": when("p_size % 4 = 0", F.array(p.p_brand, p.p_type)), "states": F.array(F.struct(F.lit("hover").alias("name"), when("p_size % 4 = 1", F.lit("FOUND")).alias("status"))),
        "usage": F.struct(F.lit(None).alias("purpose"), when("p_size % 2 = 0", p.p_type).alias("when_to_use"), F.lit(None).alias("when_not_to_use"), F.array().alias("competing_components"),
                          when("p_size % 5 = 0", F.array(F.concat(F.lit("Use "), p.p_brand))).alias("disambiguation_rules"), when("p_size % 3 = 0", F.array(F.concat(F.lit("Never "), p.p_name), F.concat(F.lit("Avoid "), p.p_type))).alias("restrictions")),
        "composition": F.array(), "accessibility": when("p_size % 6 = 0", p.p_brand), "code_examples_count": p.p_size % 3, "executable_examples_count": F.lit(0), "evidence_ids": F.array(),
    }
    kind = detectors._TYPES["components"].removeprefix("array<").removesuffix(">")
    comps = p.select(p.p_brand.alias("site_id"), F.lpad(p.p_partkey.cast("string"), 12, "0").alias("identity"), p.p_brand.alias("source"), F.struct(*[v.alias(k) for k, v in cells.items()]).cast(kind).alias("component"), F.array(p.p_brand).alias("prop_sources"))
    none = lambda schema: spark.createDataFrame([], schema)
    toks = none("site_id string, name string, value string, intent string, origin string, source string, confidence double, nth struct<origin:int,page:string,file:string,n:long,name:string>")
    pats = none("site_id string, url string, name string, components array<string>")
    return detectors.evidence(comps, toks, pats).select("site_id", "id", "component", "location", "content", "type", "section", "status", "confidence")


@query("C02_token_evidence", """
  SELECT l_orderkey, first(p_brand ORDER BY l_linenumber, l_partkey) FILTER (WHERE p_partkey % 2 = 0) AS source
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def token_evidence(spark, sf):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    tokens = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(ids.alias("evidence_ids"))
    evidence = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("source"))
    return relational.first_evidence(tokens, "evidence_ids", evidence).select(F.col("id").alias("l_orderkey"), "source")


@query("D05_token_counts", """
  SELECT source, count(*) AS tokens FROM (SELECT first(p_brand ORDER BY l_linenumber, l_partkey) FILTER (WHERE p_partkey % 2 = 0) AS source
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey) WHERE source IS NOT NULL GROUP BY 1""")
def token_counts(spark, sf):
    return relational.tokens_per_source(token_evidence(spark, sf))


@query("C04_unused_tabs", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN min(p_type) OVER (PARTITION BY p_brand) END AS tab_of FROM part")
def unused_tabs(spark, sf):
    p = _t(spark, sf, "part")
    used = F.when(p.p_partkey % 3 == 0, F.array(F.lit("tokens"))).otherwise(F.array().cast("array<string>"))
    rows = p.select("p_partkey", F.col("p_brand").alias("identity"), used.alias("used_as"))
    return relational.unused_names(rows, p.select(F.col("p_brand").alias("identity"), F.col("p_type").alias("name"))).select("p_partkey", "tab_of")


@query("C17_texts_by_dimension", "SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) AS texts FROM orders GROUP BY 1")
def texts_by_dimension(spark, sf):
    return reading.texts_by(_t(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", ["o_orderkey"], "; ", "texts")


@query("F04_child_sitemaps", f"""
  SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY {_d_host()} ORDER BY CASE WHEN regexp_matches(url, '(?i)doc|design|component|page') THEN 0 ELSE 1 END, page_id) AS n FROM pages) WHERE n <= 6""")
def child_sitemaps(spark, sf):
    p = _t(spark, sf, "pages")
    return frontier.child_sitemaps(p.select(urls.host(p.url).alias("site_id"), "url", F.col("page_id").alias("ord"))).select(F.col("ord").alias("page_id"))


@query("F05_top_losses", """
  SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity * l_discount DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 6""")
def top_losses(spark, sf):
    order = [(F.col("l_quantity") * F.col("l_discount")).desc(), "l_orderkey", "l_linenumber", "l_partkey"]
    return relational.top_per(_t(spark, sf, "lineitem"), ["l_suppkey"], order, 6).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("H30_disambiguation", "SELECT p_partkey, p_name AS competitor FROM part")
def disambiguation(spark, sf):
    said = F.concat(F.lit("Fine as it is. Use tabs instead of the "), "p_name", F.lit(" when it is short. Use it."))
    return _t(spark, sf, "part").select("p_partkey", F.array_join(html_scan.disambiguation(said), ",").alias("competitor"))


@query("H45_feedback", """
  SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'SPAM' WHEN o_orderkey % 5 = 0 THEN 'MISSING_FIELD' WHEN o_orderkey % 5 = 1 THEN 'INVALID_FIELD'
    WHEN o_orderkey % 7 NOT BETWEEN 1 AND 5 THEN 'MISSING_FIELD' WHEN o_orderkey % 11 = 0 THEN 'INVALID_FIELD' END AS code,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 5 < 2 THEN 'ds_url' WHEN o_orderkey % 7 NOT BETWEEN 1 AND 5 THEN 'rating' WHEN o_orderkey % 11 = 0 THEN 'email' END AS field FROM orders""")
def feedback(spark, sf):
    o = _t(spark, sf, "orders")
    k = o.o_orderkey
    url = F.when(k % 5 == 0, " \r\n").when(k % 5 == 1, "ftp://a.com").otherwise(" https://a.com/x ")
    mail = F.when(k % 11 == 0, "not an address").when(k % 11 == 1, "a@b.co").otherwise("")
    return o.select("o_orderkey", requests.feedback(url, k % 7, mail, F.when(k % 13 == 0, "x")).alias("r")).select("o_orderkey", "r.code", "r.field")


@query("H46_client_ip", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || user_id WHEN event_id % 3 = 0 THEN 'unknown' ELSE '1.2.3.4' END AS ip FROM events")
def client_ip(spark, sf):
    e = _t(spark, sf, "events")
    sent = F.concat(F.lit("9.9.9.9, 10.0.0."), e.user_id.cast("string"), F.lit(" ,"))
    return e.select("event_id", requests.client_ip(sent, F.when(e.event_id % 3 != 0, "1.2.3.4"), e.event_id % 2 == 0).alias("ip"))


@query("H47_error_codes", """
  SELECT event_id, CASE event_type WHEN 'error' THEN 400 WHEN 'signup' THEN 400 WHEN 'click' THEN 422 ELSE 500 END AS status,
    CASE event_type WHEN 'error' THEN 'BLOCKED' WHEN 'signup' THEN 'NOT_RESOLVED' WHEN 'click' THEN 'UNREACHABLE_TIMEOUT' ELSE 'INTERNAL' END AS code FROM events""")
def error_codes(spark, sf):
    e = _t(spark, sf, "events")
    said = F.when(e.event_type == "error", "Blocked: private").when(e.event_type == "signup", "Could not resolve hostname x").when(e.event_type == "click", requests.entry_error(F.lit("TIMEOUT"), F.lit(0))).otherwise("x")
    return e.select("event_id", requests.error_code(said).alias("r")).select("event_id", "r.status", "r.code")


@query("H48_source_reasons", """
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'srHttp404' WHEN 1 THEN 'srHttpRefused' WHEN 2 THEN 'srHttpServer' WHEN 3 THEN 'srHttpOther' WHEN 4 THEN 'PAGE_LIMIT' ELSE '' END AS reason FROM events""")
def source_reasons(spark, sf):
    e = _t(spark, sf, "events")
    codes = F.array(*[F.lit(x) for x in ("HTTP_404", "HTTP_429", "HTTP_503", "HTTP_418", "PAGE_LIMIT", None)])
    return e.select("event_id", requests.reason_key(F.element_at(codes, (e.event_id % 6 + 1).cast("int"))).alias("reason"))


_BUDGET = f"""WITH r AS (SELECT page_id, {_d_host()} AS site_id, page_id % 900 AS ms, page_id % 11 = 0 AS starts FROM pages),
  s AS (SELECT *, row_number() OVER w - 1 AS before, coalesce(sum(ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r WINDOW w AS (PARTITION BY site_id ORDER BY page_id)),
  x AS (SELECT *, coalesce(bool_or(starts AND before < 9 AND spent < 1500) OVER (PARTITION BY site_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS longer FROM s),
  f AS (SELECT *, before < 9 AND spent < CASE WHEN longer THEN 2700 ELSE 1500 END AS inside FROM x)"""


def _budget(spark, sf):
    p = _t(spark, sf, "pages")
    rows = p.select("page_id", urls.host(p.url).alias("site_id"), (p.page_id % 900).alias("ms"), (p.page_id % 11 == 0).alias("starts"))
    return frontier.within_budget(rows, ["site_id"], ["page_id"], 9, 1500, 1200, "starts")


@query("I07_budgets", f"{_BUDGET} SELECT page_id, inside, NOT inside AND before < 9 AS time_limited FROM f")
def budgets(spark, sf):
    return _budget(spark, sf).select("page_id", "inside", "time_limited")


@query("I07_limits_reached", f"{_BUDGET} SELECT site_id, bool_or(NOT inside) AS crawl_limited, bool_or(NOT inside AND before < 9) AS time_limited FROM f GROUP BY 1")
def limits_reached(spark, sf):
    return frontier.limits_reached(_budget(spark, sf), ["site_id"])


@query("I08_frontier", """
  WITH RECURSIVE e AS (SELECT DISTINCT l_returnflag AS site_id, l_suppkey AS src, l_partkey AS dst FROM lineitem),
  r AS (SELECT site_id, min(src) AS url, 0 AS depth FROM e GROUP BY 1 UNION SELECT r.site_id, e.dst, r.depth + 1 FROM r JOIN e ON e.site_id = r.site_id AND e.src = r.url WHERE r.depth < 3)
  SELECT site_id, url, min(depth) AS depth FROM r GROUP BY 1, 2""")
def frontier_steps(spark, sf):
    e = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("site_id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return frontier.reached(e, e.groupBy("site_id").agg(F.min("src").alias("url")))


@query("I09_refill")
def refill(spark, sf):
    p = _t(spark, sf, "pages")
    kinds = F.element_at(F.array(*[F.lit(k) for k in frontier.KINDS]), (p.page_id % 5 + 1).cast("int"))
    rows = p.select(urls.host(p.url).alias("site_id"), "url", F.col("page_id").alias("ord"), kinds.alias("kind"), (p.page_id % 7 == 0).alias("failed"))
    return frontier.refilled(rows.filter("ord % 2 = 0"), rows.filter("ord % 2 = 1").withColumn("ok", ~F.col("failed")))
