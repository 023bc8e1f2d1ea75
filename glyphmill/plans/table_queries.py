"""Queries over events, conversations and the order tables: aggregates, windows, limits and score arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.functions import numbers, text
from glyphmill.operators import json_tokens, relational, scoring
from glyphmill.plans.registry import query
from glyphmill.streaming import limits


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("I01_rate_limit", """
  SELECT a.event_id, count(*) AS n_recent, count(*) > 5 AS rejected FROM events a JOIN events b ON a.user_id = b.user_id
   AND epoch_us(b.ts) > epoch_us(a.ts) - 60000000 AND (epoch_us(b.ts) < epoch_us(a.ts) OR (b.ts = a.ts AND b.event_id <= a.event_id)) GROUP BY 1""")
def rate_limit(spark, sf):
    return limits.rate_limited(_t(spark, sf, "events"), "user_id", "ts", "event_id").select("event_id", "n_recent", "rejected")


@query("I02_feedback_limit", """
  SELECT a.event_id, count(*) AS n_recent, count(*) > 5 AS rejected FROM events a JOIN events b ON a.event_type = b.event_type
   AND epoch_us(b.ts) > epoch_us(a.ts) - 600000000 AND (epoch_us(b.ts) < epoch_us(a.ts) OR (b.ts = a.ts AND b.event_id <= a.event_id)) GROUP BY 1""")
def feedback_limit(spark, sf):
    return limits.rate_limited(_t(spark, sf, "events"), "event_type", "ts", "event_id", 5, 600).select("event_id", "n_recent", "rejected")


@query("I03_state_eviction", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) >= 86400000000")
def eviction(spark, sf):
    e = _t(spark, sf, "events")
    now = e.agg(F.max("ts").cast("timestamp").alias("now"))
    return limits.evicted(e.join(F.broadcast(now)), "user_id", "ts", "now", 86_400)


@query("I04_concurrency", "SELECT event_id, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS active FROM events")
def concurrency(spark, sf):
    e = _t(spark, sf, "events").withColumn("day", F.to_date("ts")).withColumn("delta", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1))
    return limits.running(e, "day", "ts", "delta", "event_id").select("event_id", "active")


@query("I05_job_log", "SELECT event_id, seq FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events) WHERE seq >= 10 AND seq < 200")
def job_log(spark, sf):
    return limits.job_log(_t(spark, sf, "events"), "user_id", ["ts", "event_id"], 200, 10).select("event_id", "seq")


@query("I06_job_ttl", """
  WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
  SELECT event_id, sum(CASE WHEN gap IS NULL OR gap >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g""")
def job_ttl(spark, sf):
    return limits.sessions(_t(spark, sf, "events"), "user_id", "ts", "event_id", 3600).select("event_id", "session")


@query("H40_H41_flatten_json", """
  SELECT event_id, u.k AS name, CAST(json_extract(props, '$."' || u.k || '"') AS VARCHAR) AS value, 0.8::DOUBLE AS confidence, 'other' AS type
  FROM events, unnest(json_keys(props)) u(k)""")
def flatten_json(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("body"))
    rows = json_tokens.flatten(e)
    return rows.select(F.col("id").alias("event_id"), "name", "value", "confidence", text.guess_type(F.col("name")).alias("type"))


_BODY = """'{"name":"' || p_name || '","brand":{"' || p_brand || '":{"$value":"' || p_type || '","description":"' || p_name || '"},"n":' || p_size || '},"list":[' || p_size
  || ',"x",{"value":' || p_size || '.5},true,null,[["y"]]],"deep":{"a":{"b":{"c":{"value":null,"$value":"v"}}}},"flag":false,"version":"1","box":{"version":"2"},"e-1":"' || p_type || '"}'"""


@query("A13_H40_nested_tokens", rf"""
  WITH b AS (SELECT p_partkey, {_BODY} AS body FROM part),
  t AS (SELECT p_partkey, j.*, j.type = 'OBJECT' AND (json_exists(j.value, '$.value') OR json_exists(j.value, '$."$value"')) AS token FROM b, json_tree(b.body) j),
  own AS (SELECT t.* FROM t LEFT JOIN t u ON u.p_partkey = t.p_partkey AND u.id = t.parent WHERE NOT coalesce(u.token, false))
  SELECT p_partkey, replace(regexp_replace(substr(fullkey, 3), '\[(\d+)\]', '.\1', 'g'), '"', '') AS name,
         CASE WHEN token THEN coalesce(value ->> '$.value', value ->> '$."$value"') ELSE value ->> '$' END AS value,
         CASE WHEN token THEN value ->> '$.description' END AS intent, CASE WHEN token THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence
  FROM own WHERE token OR (type IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') AND NOT (path = '$' AND key IN ('$schema', 'version', 'name', 'description')))""")
def nested_tokens(spark, sf):
    body = F.expr(_BODY)
    return json_tokens.flatten(_t(spark, sf, "part").select(F.col("p_partkey").alias("id"), body.alias("body"))).withColumnRenamed("id", "p_partkey")


@query("A13_token_json", "SELECT event_id FROM events WHERE json_valid(props) AND json_type(props) = 'OBJECT'")
def token_json(spark, sf):
    e = _t(spark, sf, "events")
    return e.filter(F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT")).select("event_id")


@query("D02_coalesce_first", "SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'assistant' AND text <> '') AS first_text FROM conversations GROUP BY 1")
def coalesce_first(spark, sf):
    c = _t(spark, sf, "conversations")
    return relational.coalesce_first(c, ["conv_id"], F.when(c.role == "assistant", c.text), c.turn, "first_text")


@query("E06_evidence_ids", "SELECT conv_id, turn, 'ev-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS id FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n FROM conversations)")
def evidence_ids(spark, sf):
    return relational.numbered_ids(_t(spark, sf, "conversations"), ["role"], ["conv_id", "turn"]).select("conv_id", "turn", "id")


@query("E05_capped_list", """
  SELECT event_id, event_type = 'purchase' OR rn <= 60 AS listed, CASE WHEN event_type = 'purchase' THEN 0 ELSE greatest(n - 60, 0) END::BIGINT AS truncated FROM (
    SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)""")
def capped(spark, sf):
    return relational.capped(_t(spark, sf, "events"), "event_type", ["event_id"], 60, ["purchase"]).select("event_id", "listed", "truncated")


@query("D06_D17_status_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) AS total FROM events GROUP BY 1")
def status_counts(spark, sf):
    e = _t(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count_if(e.event_type == "error").alias("errors"), F.count_if(e.event_type == "click").alias("clicks"), F.count("*").alias("total"))


@query("D11_name_repetition", """
  WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
  SELECT l_suppkey, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n) AS consistency FROM c GROUP BY 1""")
def repetition(spark, sf):
    return scoring.repetition_of(_t(spark, sf, "lineitem").select("l_suppkey", F.col("l_partkey").cast("string").alias("name")), ["l_suppkey"], "name")


@query("D12_naming_consistency", """
  SELECT source, CASE WHEN count(*) < 2 THEN true ELSE avg(CASE WHEN contains(text, '%%%') THEN 1.0 ELSE 0.0 END) > 0.8 OR avg(CASE WHEN contains(text, '%%%') THEN 1.0 ELSE 0.0 END) < 0.2 END AS consistent FROM documents GROUP BY 1""")
def naming(spark, sf):
    d = _t(spark, sf, "documents")
    share = F.avg(F.contains("text", F.lit("%%%")).cast("double"))
    return d.groupBy("source").agg(F.when(F.count("*") < 2, True).otherwise((share > 0.8) | (share < 0.2)).alias("consistent"))


@query("D04_D09_ratios", """
  SELECT l_returnflag, sum(l_linenumber)::BIGINT AS total, count(*) FILTER (WHERE l_discount > 0.05)::DOUBLE / count(*) AS share,
         CASE WHEN count(*) FILTER (WHERE l_tax > 5) > 0 THEN 1.0 / count(*) FILTER (WHERE l_tax > 5) END::DOUBLE AS empty_base FROM lineitem GROUP BY 1""")
def ratios(spark, sf):
    li = _t(spark, sf, "lineitem")
    base = F.count_if(li.l_tax > 5)
    return li.groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("total"), numbers.ratio(F.count_if(li.l_discount > 0.05), F.count("*")).alias("share"), numbers.ratio(F.lit(1), base).alias("empty_base"))


@query("D10_states_ratio", "SELECT l_suppkey, CASE WHEN count(*) FILTER (WHERE l_returnflag IN ('A', 'N')) > 0 THEN count(*) FILTER (WHERE l_returnflag = 'A')::DOUBLE / count(*) FILTER (WHERE l_returnflag IN ('A', 'N')) END AS share FROM lineitem GROUP BY 1")
def states(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.groupBy("l_suppkey").agg(numbers.ratio(F.count_if(li.l_returnflag == "A"), F.count_if(li.l_returnflag.isin("A", "N"))).alias("share"))


@query("D14_masked_ratio", "SELECT l_orderkey, CASE WHEN sum(l_quantity) FILTER (WHERE l_returnflag <> 'R') > 0 THEN sum(l_linenumber) FILTER (WHERE l_returnflag <> 'R') * 100.0::DOUBLE / sum(l_quantity) FILTER (WHERE l_returnflag <> 'R') END AS score FROM lineitem GROUP BY 1")
def masked(spark, sf):
    li = _t(spark, sf, "lineitem")
    seen = li.l_returnflag != "R"
    return li.groupBy("l_orderkey").agg((numbers.ratio(F.sum(F.when(seen, li.l_linenumber)) * 100.0, F.sum(F.when(seen, li.l_quantity)))).alias("score"))


@query("C10_D15_weighted_mean", """
  SELECT o_custkey, sum(s * w) / sum(w) AS score FROM (
    SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice) END AS s, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 ELSE 1 END AS w FROM orders) WHERE s IS NOT NULL GROUP BY 1""")
def weighted(spark, sf):
    weights = spark.createDataFrame([("1-URGENT", 4.0), ("2-HIGH", 3.0)], "o_orderpriority string, w double")
    o = _t(spark, sf, "orders").join(F.broadcast(weights), "o_orderpriority", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    o = o.withColumn("s", F.when(F.col("o_orderstatus") != "P", F.round("o_totalprice"))).filter("s IS NOT NULL")
    return o.groupBy("o_custkey").agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("score"))


@query("C12_percent_bands", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.9 THEN 20.0 WHEN l_discount * 10 >= 0.7 THEN 17.0 WHEN l_discount * 10 >= 0.5 THEN 14.0 WHEN l_discount * 10 >= 0.3 THEN 10.0 WHEN l_discount IS NOT NULL THEN 0.0 END::DOUBLE AS points FROM lineitem")
def bands(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.as_of_band(F.col("l_discount") * 10, numbers.PROPS_BANDS).alias("points"))


@query("C13_H43_levels", """
  SELECT o_orderkey, shown, CASE WHEN shown >= 75 THEN 'Operable' WHEN shown >= 50 THEN 'Interpretable' WHEN shown >= 25 THEN 'Legible' ELSE 'Opaco' END AS level
  FROM (SELECT o_orderkey, floor(least(greatest(o_totalprice / 4000, 0), 100) / 5 + 0.5) * 5 AS shown FROM orders)""")
def levels(spark, sf):
    shown = numbers.round5(numbers.clamp(F.col("o_totalprice") / 4000, 0.0, 100.0))
    return _t(spark, sf, "orders").select("o_orderkey", shown.alias("shown"), numbers.readiness(shown).alias("level"))


@query("C16_address_ranges", """
  SELECT user_id, bool_or(ip BETWEEN 167772160 AND 184549375 OR ip BETWEEN 3232235520 AND 3232301055) AS private FROM (
    SELECT user_id, 167770000 + user_id * 97 AS ip FROM events) GROUP BY 1""")
def address_ranges(spark, sf):
    from glyphmill.functions import addresses

    e = _t(spark, sf, "events").select("user_id", (F.lit(167770000) + F.col("user_id") * 97).alias("ip"))
    return e.groupBy("user_id").agg(F.bool_or(addresses.private_v4(F.col("ip"))).alias("private"))


@query("H36_normalize_empty", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE trim(p_name) END AS v FROM part")
def empty(spark, sf):
    p = _t(spark, sf, "part")
    raw = F.when(p.p_partkey % 3 == 0, F.element_at(F.array(F.lit("-"), F.lit(" n/a "), F.lit("None"), F.lit("")), (p.p_partkey / 3 % 4 + 1).cast("int"))).otherwise(p.p_name)
    return p.select("p_partkey", text.normalize_empty(raw).alias("v"))


@query("H37_allowed_values", "SELECT p_partkey, lower(p_brand) || ',' || 'small' AS vals FROM part")
def allowed(spark, sf):
    p = _t(spark, sf, "part")
    kind = F.concat(F.lit("'"), F.lower("p_brand"), F.lit("' | 'small' | '"), F.lower("p_brand"), F.lit("'"))
    return p.select("p_partkey", F.array_join(text.allowed_values(kind), ",").alias("vals"))


@query("H39_H41_H42_token_names", """
  SELECT p_partkey, p_partkey % 2 = 0 AS is_token, CASE WHEN p_partkey % 5 = 0 THEN 'color' ELSE 'typography' END AS type, CASE WHEN p_partkey % 3 = 0 THEN 'semantic' END AS category FROM part""")
def token_names(spark, sf):
    p = _t(spark, sf, "part")
    stem = F.when(p.p_partkey % 5 == 0, "color").otherwise("font")
    name = F.when(p.p_partkey % 2 == 0, F.concat(stem, F.lit("-x"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("Not a "), stem))
    value = F.when(p.p_partkey % 3 == 0, "var(--x)").otherwise("#fff")
    return p.select("p_partkey", text.is_token_name(name).alias("is_token"), text.guess_type(name).alias("type"), text.token_category(value, F.lit("a.b")).alias("category"))


@query("G05_source_log", "SELECT user_id, arg_min(event_type, event_id) AS role, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def source_log(spark, sf):
    e = _t(spark, sf, "events")
    log = relational.source_log(e.select(F.col("user_id").alias("url"), F.col("event_id").alias("ord"), F.col("event_type").alias("role"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("reason")))
    return log.select(F.col("url").alias("user_id"), "role", "status")


@query("G07_array_union", "SELECT l_orderkey, list_sort(list_distinct(list_concat(list(DISTINCT l_returnflag), list(DISTINCT l_linestatus)))) AS flags FROM lineitem GROUP BY 1")
def array_union(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(F.sort_array(F.array_union(F.collect_set("l_returnflag"), F.collect_set("l_linestatus"))).alias("flags"))


@query("E10_loss_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * l_discount DESC, l_linenumber) AS place FROM lineitem")
def loss_rank(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy((F.col("l_quantity") * F.col("l_discount")).desc(), "l_linenumber")
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.rank().over(w).cast("long").alias("place"))
