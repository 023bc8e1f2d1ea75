"""Queries on addresses, listings and sources of design systems, whose addresses and bodies Spark makes of the rows of parts, orders and suppliers.

Both engines make them by the same expression; what they mean is computed by the engine's operators here and spelled out in SQL beside."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import addresses, text, urls
from glyphmill.operators import detectors, frontier
from glyphmill.plans.page_queries import _d_host, _d_path, _d_segments
from glyphmill.plans.registry import query
from glyphmill.sources import listings


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SEG = "replace(p_name, ' ', '-')"
_URL = f"""'https://ds' || (p_partkey % 40) || '.example.com/' || CASE p_partkey % 12 WHEN 0 THEN 'components/' || {_SEG} || '/usage' WHEN 1 THEN 'Components/' || {_SEG} WHEN 2 THEN 'react-' || {_SEG} || '/'
  WHEN 3 THEN 'patterns/' || {_SEG} WHEN 4 THEN 'foundations/design-tokens/' || {_SEG} WHEN 5 THEN 'styles/Color' WHEN 6 THEN 'components/' || {_SEG} || '/tokens' WHEN 7 THEN 'docs/components/overview'
  WHEN 8 THEN 'guides/motion/' || {_SEG} || '?theme=dark' WHEN 9 THEN 'api/auth-token' WHEN 10 THEN 'components/ios/overview' ELSE '' END"""
_LOW, _SEGS, _PATH = f"lower({_d_path()})", _d_segments(), _d_path()
_SLUG, _PARENT = f"coalesce(lower({_SEGS}[-1]), '')", f"coalesce(lower({_SEGS}[-2]), '')"
_IN = f"(regexp_matches({_PATH}, '(?i)/components?/') OR regexp_matches({_PATH}, '(?i)/react-[a-z0-9-]+/?$'))"
_TAB = f"(list_contains({_list(urls.TABS)}, {_SLUG}) AND {_PARENT} <> '' AND NOT regexp_matches({_PARENT}, '^(components?|componentes?)$') AND NOT list_contains({_list(urls.GENERIC)}, {_PARENT}))"
_COMPONENT = f"({_IN} AND (NOT list_contains({_list(urls.GENERIC)}, {_SLUG}) OR {_TAB}))"
_TOKEN = f"(regexp_matches({_LOW}, 'tokens?') AND NOT regexp_matches({_LOW}, '{urls.NOT_DESIGN}'))"
_IDENTITY = f"CASE WHEN len({_SEGS}) >= 2 AND list_contains({_list(urls.TABS)}, lower({_SEGS}[-1])) THEN lower({_SEGS}[-2]) ELSE coalesce(lower({_SEGS}[-1]), url) END"
_PARTS = f"(SELECT p_partkey, p_name, p_type, {_URL} AS url FROM part)"


def _parts(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", "p_name", "p_type", F.expr(_URL).alias("url"))


def address_query(name, columns, oracle):
    """A projection of the parts' addresses: p_partkey and columns(frame)."""

    @query(name, f"SELECT p_partkey, {oracle} FROM {_PARTS}")
    def run(spark, sf):
        p = _parts(spark, sf)
        return p.select("p_partkey", *[c.alias(n) for n, c in columns(p).items()])

    return run


address_query("B11_H04_component_pages", lambda p: {"page": urls.is_component_page(p.url), "identity": urls.component_identity(p.url)}, f"{_COMPONENT} AS page, {_IDENTITY} AS identity")
address_query("B12_design_token_pages", lambda p: {"token": urls.is_design_token(p.url)}, f"{_TOKEN} AS token")
address_query("E04_token_page_rank", lambda p: {"rank": urls.token_page_rank(p.url)}, f"""CASE WHEN {_TOKEN} THEN 0 WHEN len(list_filter({_SEGS}, lambda s: regexp_matches(lower(s), '{urls.CORE_SEGMENT}'))) > 0 THEN 1
  WHEN regexp_matches({_LOW}, '{urls.CORE_WORD}') THEN 2 WHEN regexp_matches({_LOW}, '{urls.STYLE_WORD}') THEN 3 ELSE 4 END AS rank""")
_LINK = "url || CASE p_partkey % 3 WHEN 0 THEN '/tokens' WHEN 1 THEN '/../tokens' ELSE '/tokens/' END"
_BASE = f"regexp_replace({_LOW}, '/+$', '')"
address_query("B13_token_tabs", lambda p: {"tab": urls.is_token_tab(F.expr(_LINK), p.url)}, f"""regexp_replace(lower({_d_path("(" + _LINK + ")")}), '/+$', '')
  IN ({_BASE} || '/tokens', regexp_replace({_BASE}, '/[^/]*$', '') || '/tokens') AS tab""")
_TITLE = "CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN '  ' || upper(p_name) || '  component' ELSE p_type END"
_FOLD = "regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
address_query("H34_component_names", lambda p: {"name": text.component_name(F.expr(_TITLE), F.expr(_SEG))}, f"""coalesce(list_filter(list_transform(range(1, len(string_split({{t}}, ' ')) + 1),
    lambda k: array_to_string(string_split({{t}}, ' ')[1:k], ' ')), lambda w: {_FOLD.format(x="w")} = {_FOLD.format(x=_SEG)})[1], {{t}}) AS name""".format(t=f"trim(regexp_replace({_TITLE}, ' +', ' ', 'g'))"))
_HTML = """'<p>' || p_name || '</p>' || CASE p_partkey % 5 WHEN 0 THEN '<iframe title="x" src="https://codesandbox.io/embed/' || p_partkey || '"></iframe>' WHEN 1 THEN '<a href="https://stackblitz.com/edit/a">open</a><div class="playground">' ELSE '' END
  || CASE WHEN p_partkey % 7 = 0 THEN '<div data-playground></div><iframe src="/about.html">' ELSE '' END"""
_DEMO = (
    r"""(?i)<iframe\b[^<>]*\bsrc\s*=\s*["''][^"'']*(storybook|iframe\.html|codesandbox|stackblitz|codepen|playground|sandbox|demo)[^"'']*["'']"""
    r"""|<a\b[^<>]*\bhref\s*=\s*["''][^"'']*(codesandbox\.io|stackblitz\.com|codepen\.io)[^"'']*["'']|\b(data-)?(playground|live-?demo|live-?code|sandpack)\b"""
)
address_query("H24_live_demos", lambda p: {"n": text.live_demos(F.expr(_HTML)).cast("long")}, f"CAST(len(regexp_extract_all({_HTML}, '{_DEMO}')) AS BIGINT) AS n")

_IP = """CASE p_partkey % 10 WHEN 0 THEN '10.' || (p_partkey % 250) || '.0.1' WHEN 1 THEN '172.' || (p_partkey % 40) || '.9.9' WHEN 2 THEN '8.8.' || (p_partkey % 250) || '.8' WHEN 3 THEN '::ffff:192.168.0.' || (p_partkey % 250)
  WHEN 4 THEN '::ffff:93.184.216.' || (p_partkey % 250) WHEN 5 THEN 'fe80::' || (p_partkey % 999) WHEN 6 THEN 'fd00:' || (p_partkey % 999) || '::1' WHEN 7 THEN '2606:4700::' || (p_partkey % 999) WHEN 8 THEN '[::1]' ELSE 'host' || p_partkey END"""
address_query("H44_C16_private_addresses", lambda p: {"private": addresses.private(F.expr(_IP))}, f"""CASE p_partkey % 10 WHEN 0 THEN true WHEN 1 THEN p_partkey % 40 BETWEEN 16 AND 31 WHEN 2 THEN false
  WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true WHEN 6 THEN true WHEN 7 THEN false WHEN 8 THEN true END AS private""")

_OFFICIAL = """CASE s_suppkey % 7 WHEN 0 THEN 'https://github.com/owner' || (s_suppkey % 5) || '/repo.git' WHEN 1 THEN 'https://github.com/owner' || (s_suppkey % 5) || '/repo/tree/main' WHEN 2 THEN 'https://www.npmjs.com/package/@ds/core' || (s_suppkey % 3) || '/v/1'
  WHEN 3 THEN 'https://storybook.ds.com/?path=/story/a' || s_suppkey WHEN 4 THEN 'https://ds.com/storybook/index.html?x=' || s_suppkey WHEN 5 THEN 'https://github.com/sponsors/ds' ELSE 'https://ds.com/page' || s_suppkey END"""
_LABEL = "CASE s_suppkey % 4 WHEN 0 THEN 'Source code' WHEN 1 THEN 'The npm package' WHEN 2 THEN 'Open Storybook' ELSE 'Home' END"
_KIND = """CASE WHEN s_suppkey % 7 IN (0, 1) THEN 'repository' WHEN s_suppkey % 7 = 2 THEN 'package' WHEN s_suppkey % 7 IN (3, 4) THEN 'storybook'
  WHEN s_suppkey % 4 = 0 THEN 'repository' WHEN s_suppkey % 4 = 1 THEN 'package' WHEN s_suppkey % 4 = 2 THEN 'storybook' END"""
_KEY = f"""CASE WHEN s_suppkey % 7 IN (0, 1) THEN 'https://github.com/owner' || (s_suppkey % 5) || '/repo' WHEN s_suppkey % 7 = 2 THEN 'https://www.npmjs.com/package/@ds/core' || (s_suppkey % 3) WHEN s_suppkey % 7 = 3 THEN 'https://storybook.ds.com'
  WHEN s_suppkey % 7 = 4 THEN 'https://ds.com/storybook' WHEN {_KIND} = 'repository' AND s_suppkey % 7 = 5 THEN 'https://github.com/sponsors/ds' WHEN {_KIND} = 'repository' THEN NULL WHEN {_KIND} = 'storybook' THEN CASE s_suppkey % 7 WHEN 5 THEN 'https://github.com' ELSE 'https://ds.com' END
  ELSE {_OFFICIAL} END"""


def _official(spark, sf):
    return _t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("site_id"), F.expr(_OFFICIAL).alias("url"), F.expr(_LABEL).alias("label"))


@query("H06_H07_H09_official_sources", f"SELECT s_suppkey, {_KIND} AS kind, CASE WHEN {_KIND} IS NULL THEN {_OFFICIAL} ELSE {_KEY} END AS key FROM supplier")
def official_kinds(spark, sf):
    kind = F.coalesce(urls.official_kind(F.col("url")), urls.label_kind(F.col("label")))
    return _official(spark, sf).withColumn("kind", kind).select("s_suppkey", "kind", urls.official_key(F.col("url"), F.col("kind")).alias("key"))


@query("K11_declared_sources", f"""
  SELECT s_suppkey, kind FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY s_nationkey, key ORDER BY s_suppkey) AS k FROM (SELECT s_suppkey, s_nationkey, {_KIND} AS kind, {_KEY} AS key FROM supplier) WHERE kind IS NOT NULL) WHERE k = 1) WHERE n <= {frontier.MAX_OFFICIAL}""")
def declared_sources(spark, sf):
    return frontier.official_sources(_official(spark, sf).withColumn("ord", F.col("s_suppkey"))).select("s_suppkey", "kind")


@query("H08_storybook_candidates", """
  SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['https://ds.com/a/b/index.json', 'https://ds.com/a/b/stories.json', 'https://ds.com/index.json', 'https://ds.com/stories.json']
    ELSE ['https://ds.com/index.json', 'https://ds.com/stories.json'] END) AS url FROM supplier""")
def storybook_candidates(spark, sf):
    at = F.when(F.col("s_suppkey") % 2 == 0, "https://ds.com/a/b//?id=1").otherwise("https://ds.com")
    return _t(spark, sf, "supplier").select("s_suppkey", F.explode(urls.storybook_candidates(at)).alias("url"))


@query("K12_manifest_probe", """
  SELECT o_custkey AS site_id, CASE WHEN bool_or(real) THEN 'FOUND' WHEN bool_and(missing) THEN 'ABSENT' ELSE 'UNKNOWN' END AS llms_txt FROM (SELECT o_custkey,
    o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 AS real, o_orderkey % 5 IN (1, 2) OR (o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0) AS missing FROM orders) GROUP BY 1""")
def manifest_probe(spark, sf):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, (200, 404, 410, 500, 429))), (k % 5 + 1).cast("int"))
    body = F.when(k % 3 == 0, "# Docs").when(k % 3 == 1, " <html>")
    answers = _t(spark, sf, "orders").select(F.col("o_custkey").alias("site_id"), status.alias("http_status"), F.when(k % 3 == 2, "text/html").otherwise("text/plain").alias("content_type"), body.alias("body"))
    return detectors.probe(answers)


_SITEMAP = """CASE WHEN n_nationkey % 4 = 0 THEN '<sitemapindex ' ELSE '<urlset ' END || 'xmlns="x"><url><loc>https://n' || n_nationkey || '.com/a?x=1&amp;y=2</loc></url><URL><LOC><![CDATA[ https://n' || n_nationkey || '.com/b ]]></LOC></URL><loc >https://n' || n_nationkey || '.com/c</loc ><loc>open'"""


@query("A09_sitemaps", """
  SELECT n_nationkey, n_nationkey % 4 = 0 AS is_index, 'https://n' || n_nationkey || '.com/' || unnest(['a?x=1&y=2', 'b', 'c']) AS loc FROM nation""")
def sitemaps(spark, sf):
    return listings.sitemap(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.expr(_SITEMAP).alias("body"))).withColumnRenamed("id", "n_nationkey")


@query("A10_robots", """SELECT n_nationkey, 'https://n' || n_nationkey || '.com/' || unnest(['s.xml', 't.xml']) AS sitemap FROM nation""")
def robots(spark, sf):
    body = F.expr("'User-agent: *\\r\\nDisallow: /x\\r\\n  SITEMAP : https://n' || n_nationkey || '.com/s.xml extra\\nsitemap:https://n' || n_nationkey || '.com/t.xml\\n# end'")
    return listings.robots(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), body.alias("body"))).withColumnRenamed("id", "n_nationkey")


@query("A11_markdown_links", """
  SELECT n_nationkey, 'https://n' || n_nationkey || '.com/' || unnest(['docs/a', 'b?k=1', 'c,']) AS url FROM nation""")
def markdown_links(spark, sf):
    n = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit("# N\n- [A](docs/a): x\n- [B]( /b?k=1&utm_source=z )\nsee https://n"), n, F.lit(".com/c, and [again](docs/a#top) [mail](mailto:x@y)"))
    return listings.markdown_links(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), body.alias("body")), F.concat(F.lit("https://n"), F.col("id"), F.lit(".com/llms.txt"))).withColumnRenamed("id", "n_nationkey")


@query("A12_storybook_index", """
  SELECT n_nationkey, unnest(CASE n_nationkey % 3 WHEN 0 THEN [n_name, 'Card'] WHEN 1 THEN ['Old ' || n_name] ELSE CAST([] AS VARCHAR[]) END) AS name FROM nation""")
def storybook_index(spark, sf):
    body = F.expr("""CASE n_nationkey % 3 WHEN 0 THEN '{"v":4,"entries":{"a":{"title":"Parts/' || n_name || '","type":"story"},"b":{"title":"Parts/Forms/ Card "},"c":{"title":"Other/Card"}}}'
      WHEN 1 THEN '{"v":3,"stories":{"a":{"kind":"Old ' || n_name || '"}}}' ELSE 'no index' END""")
    return listings.storybook(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), body.alias("body"))).withColumnRenamed("id", "n_nationkey")


@query("A17_docc_candidates", f"""
  SELECT p_partkey, unnest(['.md', '.json']) AS suffix, 'https://' || {_d_host()} || '/tutorials/data' || regexp_replace({_PATH}, '/+$', '') || suffix AS url FROM {_PARTS}""")
def docc(spark, sf):
    found = _parts(spark, sf).select("p_partkey", F.explode(listings.docc_candidates(F.col("url"))).alias("url"))
    return found.select("p_partkey", F.regexp_extract("url", r"(\.md|\.json)$", 1).alias("suffix"), "url")


@query("K08_best_listing", """
  WITH f AS (SELECT DISTINCT o_custkey AS site_id, CASE o_orderkey % 4 WHEN 0 THEN 'links' WHEN 1 THEN 'navigation' WHEN 2 THEN 'sitemap' ELSE 'llms.txt' END AS method, o_orderkey % 4 AS rank, o_orderkey % 50 AS page FROM orders)
  SELECT site_id, method, 'https://x.com/' || page AS url FROM (SELECT *, max(rank) OVER (PARTITION BY site_id) AS best FROM f) WHERE rank = best""")
def best_listing(spark, sf):
    k = F.col("o_orderkey")
    method = F.element_at(F.array(*map(F.lit, ("links", "navigation", "sitemap", "llms.txt"))), (k % 4 + 1).cast("int"))
    return frontier.listing(_t(spark, sf, "orders").select(F.col("o_custkey").alias("site_id"), method.alias("method"), F.concat(F.lit("https://x.com/"), k % 50).alias("url")))


@query("K09_root_widening", """
  SELECT c_custkey AS site_id, c_custkey % 3 = 0 AND c_custkey % 2 = 0 AS widened, CASE WHEN c_custkey % 6 = 0 THEN 5 ELSE c_custkey % 3 END AS components_found, CASE WHEN c_custkey % 6 = 0 THEN 'wide' ELSE 'narrow' END AS root FROM customer""")
def root_widening(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("site_id"))
    narrow = c.select("site_id", (F.col("site_id") % 3).alias("components_found"), F.lit("narrow").alias("root"))
    wide = c.filter("site_id % 2 = 0").select("site_id", F.lit(5).cast("long").alias("components_found"), F.lit("wide").alias("root"))
    return frontier.widened(narrow, wide)


_TABS = _list(urls.TAB_ORDER[:12])


@query("K10_tabs_to_read", f"""
  WITH l AS (SELECT l_returnflag AS site_id, l_partkey % 50 AS c, {_TABS}[l_suppkey % 12 + 1] AS tab, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
  d AS (SELECT site_id, c, tab, min(ord) AS ord FROM l WHERE tab <> 'usage' GROUP BY 1, 2, 3)
  SELECT site_id, 'https://ds.com/components/c' || c || '/' || tab AS link FROM (SELECT *, row_number() OVER (PARTITION BY site_id, c ORDER BY ord) AS rn FROM d) WHERE rn + 1 <= {frontier.MAX_TABS}""")
def tabs_to_read(spark, sf):
    page = F.concat(F.lit("https://ds.com/components/c"), F.col("l_partkey") % 50)
    tab = F.element_at(F.array(*map(F.lit, urls.TAB_ORDER[:12])), (F.col("l_suppkey") % 12 + 1).cast("int"))
    rows = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("site_id"), F.concat(page, F.lit("/usage")).alias("page"), F.concat(page, F.lit("/"), tab).alias("link"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    chosen = rows.select("site_id", F.col("page").alias("url")).distinct()
    return frontier.tabs_to_read(rows, chosen).select("site_id", "link")
