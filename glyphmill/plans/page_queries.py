"""Queries over the tables of pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import numbers, text, urls
from glyphmill.operators import page_blocks, relational
from glyphmill.plans.registry import query

_WS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _d_path(u: str = "url") -> str:
    return f"(CASE WHEN regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1) END)"


def _d_host(u: str = "url") -> str:
    return f"lower(regexp_extract({u}, '^https?://([^/?#:]*)', 1))"


def _d_segments(u: str = "url") -> str:
    return f"list_filter(string_split({_d_path(u)}, '/'), lambda s: s <> '')"


def _d_strip(x: str) -> str:
    for tag in ("script", "style"):
        x = rf"regexp_replace({x}, '(?is)<{tag}([\s/][^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    x = rf"replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' ')"
    return rf"regexp_replace(regexp_replace({x}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


def _d_without(x: str, *tags: str) -> str:
    for tag in tags:
        x = rf"regexp_replace({x}, '(?is)<{tag}([\s/][^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    return x


_D_BODY = r"CASE WHEN regexp_matches(html, '(?is)<body([\s/][^>]*)?>.*?</body\s*>') THEN regexp_extract(html, '(?is)<body([\s/][^>]*)?>(.*?)</body\s*>', 2) ELSE html END"
_D_VISIBLE = _d_strip(_d_without(_D_BODY, "head", "nav", "header", "footer", "noscript", "template"))


def page_query(name, columns, oracle):
    """A projection of pages: page_id and columns(frame)."""

    @query(name, f"SELECT page_id, {oracle} FROM pages")
    def run(spark, sf):
        p = _pages(spark, sf)
        return p.select("page_id", *[c.alias(n) for n, c in columns(p).items()])

    return run


page_query("H01_normalize_url", lambda p: {"normal": urls.normalize(p.url)}, f"""
  lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || {_d_path()} || coalesce(nullif('?' || array_to_string(list_transform(list_sort(list_filter(
    list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> ''),
      lambda x, i: {{'k': split_part(x, '=', 1), 'i': i, 'v': CASE WHEN contains(x, '=') THEN regexp_replace(x, '^[^=]*=', '') ELSE '' END}}),
    lambda q: NOT regexp_matches(q.k, '^(utm_\\w+|gclid|fbclid|msclkid|mc_cid|mc_eid|ref|ref_src|_ga|_gl)$'))),
    lambda q: q.k || '=' || q.v), '&'), '?'), '') AS normal""")
page_query("H02_ds_root", lambda p: {"root": urls.ds_root(p.url)}, f"""
  lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || '/' || coalesce(nullif(array_to_string(list_filter({_d_segments()},
    lambda s, i: NOT (i = len({_d_segments()}) AND regexp_matches(s, '(?i)\\.[a-z0-9]{{2,5}}$'))), '/') || '/', '/'), '') AS root""")
page_query("H03_classify_url", lambda p: {"kind": urls.classify(p.url)}, f"""CASE
  WHEN regexp_matches(lower({_d_path()}), '\\.(png|jpe?g|gif|svg|webp|ico|pdf|zip|mp4|woff2?|ttf|css|js)$') THEN 'asset'
  WHEN regexp_matches(lower({_d_path()}), 'changelog|release-notes|/releases?(/|$)|whats-new|novedades') THEN 'changelog'
  WHEN regexp_matches(lower({_d_path()}), '/components?/|/react-[a-z0-9-]+/?$') THEN 'component'
  WHEN regexp_matches(lower({_d_path()}), '/(patterns?|patrones?|templates?|plantillas?|recipes?)(/|$)') THEN 'pattern'
  WHEN regexp_matches(lower({_d_path()}), 'tokens?|{urls.FOUNDATION}') THEN 'tokens' ELSE 'other' END AS kind""")
page_query("H04_component_identity", lambda p: {"identity": urls.component_identity(p.url)},
           f"coalesce(lower({_d_segments()}[-1]), url) AS identity")
page_query("H05_path_parts", lambda p: {"path": urls.path(p.url), "last": urls.last_segment(p.url), "name": urls.path_to_name(p.url)},
           f"{_d_path()} AS path, coalesce(lower({_d_segments()}[-1]), '') AS last, coalesce({_d_segments()}[-1], url) AS name")
page_query("H10_find_blocks_p", lambda p: {"n": F.size(text.blocks(p.html, "p")).cast("long"), "first": F.try_element_at(text.blocks(p.html, "p"), F.lit(1))},
           r"len(regexp_extract_all(html, '(?is)<p([\s/][^>]*)?>(.*?)</p\s*>', 2)) AS n, regexp_extract_all(html, '(?is)<p([\s/][^>]*)?>(.*?)</p\s*>', 2)[1] AS first")
page_query("H11_remove_nav", lambda p: {"rest": text.without_block(p.html, "nav")}, f"{_d_without('html', 'nav')} AS rest")
page_query("H12_strip_tags", lambda p: {"txt": text.strip_tags(p.html)}, f"{_d_strip('html')} AS txt")
page_query("H13_visible_text_length", lambda p: {"n": text.visible_text_length(p.html).cast("long")}, f"length({_D_VISIBLE}) AS n")
page_query("H14_headings", lambda p: {"titles": F.array_join(text.headings(p.html), " | ")},
           "array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<h1([\\s/][^>]*)?>(.*?)</h1\\s*>', 2), lambda h: "
           + _d_strip("h") + "), lambda t: t <> ''), ' | ') AS titles")
page_query("H15_code_blocks", lambda p: {"n": F.size(text.code_blocks(p.html)).cast("long")}, r"len(regexp_extract_all(html, '(?is)<pre([\s/][^>]*)?>(.*?)</pre\s*>', 2)) AS n")
page_query("H16_first_paragraph", lambda p: {"lead": text.first_paragraph(p.html)},
           "nullif(" + _d_strip(r"regexp_extract(regexp_replace(html, '(?is)^.*?<h1([\s/][^>]*)?>.*?</h1\s*>', ''), '(?is)<p([\s/][^>]*)?>(.*?)</p\s*>', 2)") + ", '') AS lead")
page_query("H25_version_signal", lambda p: {"version": text.version_signal(p.html)},
           rf"""regexp_matches(html, '(?i)(^|[^A-Za-z0-9_])(version|versi[oó]n|v){_WS}?[0-9]+\.[0-9]+(\.[0-9]+)?([^A-Za-z0-9_]|$)')
           OR regexp_matches(html, '(?i)(^|[^A-Za-z0-9_])(last updated|updated on|last modified|[uú]ltima actualizaci[oó]n|actualizado el)([^A-Za-z0-9_]|$)')
           OR regexp_matches(html, '(?i)<time\b[^<>]*datetime=') AS version""")
page_query("H26_mcp_signal", lambda p: {"mcp": text.mcp_signal(p.html)},
           rf"regexp_matches(html, '(?i)(^|[^A-Za-z0-9_])(model context protocol|mcp server|servidor mcp|mcp{_WS}+(endpoint|integration|integraci[oó]n))([^A-Za-z0-9_]|$)') AS mcp")
page_query("B01_html_pages", lambda p: {"is_html": F.contains(F.lower("html"), F.lit("<html"))}, "contains(lower(html), '<html') AS is_html")
page_query("B05_utility_file", lambda p: {"utility": urls.is_utility(p.url)},
           f"regexp_matches(lower({_d_path()}), '(^|/)((robots|llms|humans|security)\\.txt|agents\\.md|sitemap[^/]*\\.xml|(index|stories)\\.json)$') AS utility")
page_query("B06_in_scope", lambda p: {"inside": urls.in_scope(p.url, F.lit("http://ththre.example.com/fr/"))},
           f"{_d_host()} = 'ththre.example.com' AND (starts_with(lower({_d_path()}), '/fr/') OR regexp_matches(lower({_d_path()}), '{'|'.join(urls.KEYWORDS)}')) AS inside")
page_query("B09_script_shell", lambda p: {"shell": text.is_shell(F.lit("text/html"), p.html)},
           rf"length({_D_VISIBLE}) < 40 OR regexp_matches(html, '(?i)(requires|enable|activ[ae]r?|habilit[ae]r?|necesit\w+)\s[^<>]{{0,60}}javascript') AS shell")
page_query("B10_needs_browser", lambda p: {"needs": text.needs_browser(F.lit("text/html"), p.html)},
           rf"length({_D_VISIBLE}) < 200 OR regexp_matches(html, '(?i)(requires|enable|activ[ae]r?|habilit[ae]r?|necesit\w+)\s[^<>]{{0,60}}javascript') AS needs")
page_query("C11_enum_points", lambda p: {"points": numbers.band_points(F.when(p.page_id % 3 == 0, "COMPLETE").when(p.page_id % 3 == 1, "PARTIAL").otherwise("UNKNOWN"), numbers.ACCESS_POINTS["component_index"][1])},
           "CASE WHEN page_id % 3 = 0 THEN 20.0 WHEN page_id % 3 = 1 THEN 10.0 END::DOUBLE AS points")


@query("A03_bounded_body", "SELECT page_id, CASE WHEN strlen(html) <= 8000 THEN html END AS body, CASE WHEN strlen(html) > 8000 THEN 'TOO_LARGE' ELSE 'OK' END AS status FROM pages")
def bounded_body(spark, sf):
    fits = F.octet_length("html") <= 8000
    return _pages(spark, sf).select("page_id", F.when(fits, F.col("html")).alias("body"), F.when(~fits, "TOO_LARGE").otherwise("OK").alias("status"))


@query("B02_B03_attempted", f"SELECT {_d_host()} AS host, count(*) FILTER (WHERE page_id % 7 <> 0) AS crawled, count(*) FILTER (WHERE page_id % 7 = 0) AS failed FROM pages GROUP BY 1")
def attempted(spark, sf):
    p = _pages(spark, sf).withColumn("status", F.when(F.col("page_id") % 7 == 0, "FAILED").otherwise("CRAWLED")).filter(~urls.is_utility(F.col("url")))
    return p.groupBy(urls.host(p.url).alias("host")).agg(F.count_if(F.col("status") == "CRAWLED").alias("crawled"), F.count_if(F.col("status") == "FAILED").alias("failed"))


@query("B04_readable_pages", f"SELECT page_id FROM pages WHERE length({_D_VISIBLE}) >= 200")
def readable(spark, sf):
    p = _pages(spark, sf)
    return p.filter(text.visible_text_length(p.html) >= text.MIN_READABLE).select("page_id")


@query("B07_B08_same_host_in_root", f"""
  WITH r AS (SELECT {_d_host()} AS host, min(url) AS root FROM pages GROUP BY 1)
  SELECT p.page_id, {_d_host('p.url')} = {_d_host('r.root')} AS same, starts_with(lower({_d_path('p.url')}), lower({_d_path('r.root')})) AS inside
  FROM pages p JOIN r ON r.host = {_d_host('p.url')}""")
def same_host(spark, sf):
    p = _pages(spark, sf).withColumn("host", urls.host(F.col("url")))
    r = p.groupBy("host").agg(F.min("url").alias("root"))
    return p.join(r, "host").select("page_id", urls.same_host(F.col("url"), F.col("root")).alias("same"), urls.in_root(F.col("url"), F.col("root")).alias("inside"))


@query("B15_query_variants", f"""
  SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://[^/]*/[^/?#]*', 0) ORDER BY page_id) AS rn FROM pages) WHERE rn <= 3""")
def query_variants(spark, sf):
    p = _pages(spark, sf).withColumn("base", F.regexp_extract("url", "^https?://[^/]*/[^/?#]*", 0))
    return relational.top_per(p, ["base"], ["page_id"], 3).select("page_id")


@query("H21_links", r"""
  SELECT DISTINCT page_id, trim(regexp_replace(l, '^["'']|["'']$', '', 'g')) AS link
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^<>]*?\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)) AS l FROM pages)""")
def links(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", F.explode(text.links(p.html)).alias("link")).distinct()


@query("D07_page_stats", f"""
  SELECT {_d_host()} AS host, count(*) AS pages_found, count(*) FILTER (WHERE length({_D_VISIBLE}) >= 200) AS pages_retrieved,
         count(*) FILTER (WHERE length({_D_VISIBLE}) < 200) AS pages_failed FROM pages GROUP BY 1""")
def page_stats(spark, sf):
    p = _pages(spark, sf)
    p = p.select(urls.host(p.url).alias("host"), text.visible_text_length(p.html).alias("n"))
    return p.groupBy("host").agg(F.count("*").alias("pages_found"), F.count_if(F.col("n") >= 200).alias("pages_retrieved"), F.count_if(F.col("n") < 200).alias("pages_failed"))


def access_scores(pages, least: int = text.MIN_READABLE):
    """Per host: the share of readable pages, its band, the points and the displayed score with its level."""
    p = pages.select(urls.host(pages.url).alias("host"), text.visible_text_length(pages.html).alias("n"))
    g = p.groupBy("host").agg(F.count("*").alias("attempted"), F.count_if(F.col("n") >= least).alias("readable"))
    g = g.withColumn("band", numbers.recoverability(numbers.ratio(F.col("readable"), F.col("attempted"))))
    top, table = numbers.ACCESS_POINTS["documentation_recoverability"]
    g = g.withColumn("points", numbers.band_points(F.col("band"), table))
    shown = numbers.round5(numbers.clamp(F.col("points") / top * 100, 0, 100))
    return g.withColumn("shown", shown).withColumn("level", numbers.readiness(shown))


@query("K03_access_recoverability", f"""
  WITH g AS (SELECT {_d_host()} AS host, count(*) AS attempted, count(*) FILTER (WHERE length({_D_VISIBLE}) >= 1500) AS readable FROM pages GROUP BY 1),
  b AS (SELECT *, CASE WHEN readable / attempted >= 0.9 THEN 'FULLY_RECOVERABLE' WHEN readable / attempted >= 0.5 THEN 'MOSTLY_RECOVERABLE'
                       WHEN readable > 0 THEN 'PARTIAL' ELSE 'NOT_RECOVERABLE' END AS band FROM g),
  s AS (SELECT *, CASE band WHEN 'FULLY_RECOVERABLE' THEN 15.0 WHEN 'MOSTLY_RECOVERABLE' THEN 12.0 WHEN 'PARTIAL' THEN 7.5 ELSE 0.0 END::DOUBLE AS points FROM b),
  r AS (SELECT *, floor(points / 15 * 100 / 5 + 0.5) * 5 AS shown FROM s)
  SELECT *, CASE WHEN shown >= 75 THEN 'Operable' WHEN shown >= 50 THEN 'Interpretable' WHEN shown >= 25 THEN 'Legible' ELSE 'Opaco' END AS level FROM r""")
def access(spark, sf):
    return access_scores(_pages(spark, sf), 1500)


@query("D20_recoverability_band", f"""
  WITH g AS (SELECT {_d_host()} AS host, avg(CASE WHEN length({_D_VISIBLE}) >= 3000 THEN 1.0 ELSE 0.0 END) AS share FROM pages GROUP BY 1)
  SELECT host, CASE WHEN share >= 0.9 THEN 'FULLY_RECOVERABLE' WHEN share >= 0.5 THEN 'MOSTLY_RECOVERABLE' WHEN share > 0 THEN 'PARTIAL' ELSE 'NOT_RECOVERABLE' END AS band FROM g""")
def band(spark, sf):
    return access_scores(_pages(spark, sf), 3000).select("host", "band")


@query("E02_shortest_urls", f"""
  SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY {_d_host()} ORDER BY length(url), url, page_id) AS rn FROM pages) WHERE rn <= 5""")
def shortest(spark, sf):
    p = _pages(spark, sf).withColumn("host", urls.host(F.col("url")))
    return relational.top_per(p, ["host"], [F.length("url"), "url", "page_id"], 5).select("page_id")


@query("E03_evenly_spaced", """
  WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS m FROM documents)
  SELECT DISTINCT r.doc_id, r.source FROM r JOIN range(8) t(i) ON (m > 8 AND pos = floor(i * (m / 8.0::DOUBLE) + m / 8.0::DOUBLE / 2)) OR m <= 8""")
def evenly(spark, sf):
    return relational.evenly_spaced(_docs(spark, sf).select("doc_id", "source"), ["source"], ["doc_id"], 8)


@query("F02_sorted_urls", "SELECT page_id, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY url, page_id) AS n FROM pages")
def sorted_urls(spark, sf):
    from pyspark.sql import Window

    p = _pages(spark, sf)
    return p.select("page_id", F.row_number().over(Window.partitionBy(F.split_part("url", F.lit("/"), F.lit(3))).orderBy("url", "page_id")).cast("long").alias("n"))


@query("F03_sorted_parameters", r"""
  SELECT page_id, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') AS params FROM pages""")
def sorted_parameters(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", F.array_join(F.transform(F.array_sort(urls.query_pairs(p.url)), lambda q: F.concat(q["key"], F.lit("="), q["value"])), "&").alias("params"))


@query("F07_limits_per_kind", f"""
  SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY {_d_host()}, {_d_segments()}[1] ORDER BY url, page_id) AS rn FROM pages) WHERE rn <= 8""")
def limits(spark, sf):
    p = _pages(spark, sf).withColumn("host", urls.host(F.col("url"))).withColumn("kind", F.try_element_at(urls.segments(F.col("url")), F.lit(1)))
    return relational.top_per(p, ["host", "kind"], ["url", "page_id"], 8).select("page_id")


@query("F08_sample_assembly", f"""
  WITH k AS (SELECT page_id, url, {_d_host()} AS host, {_d_segments()}[1] AS kind FROM pages),
  r AS (SELECT *, row_number() OVER (PARTITION BY host, kind ORDER BY length(url), url, page_id) AS rn FROM k),
  a AS (SELECT host, page_id, min(part) AS part FROM (
    SELECT host, page_id, 0 AS part FROM (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY length(url), url, page_id) AS x FROM k) WHERE x = 1
    UNION ALL SELECT host, page_id, 1 FROM r WHERE kind = 'en' AND rn <= 8 UNION ALL SELECT host, page_id, 2 FROM r WHERE kind = 'fr' AND rn <= 3
    UNION ALL SELECT host, page_id, 3 FROM r WHERE kind = 'de' AND rn <= 4) GROUP BY ALL)
  SELECT host, page_id, part FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY part, page_id) AS n FROM a) WHERE n <= 10""")
def sample(spark, sf):
    p = _pages(spark, sf).withColumn("host", urls.host(F.col("url"))).withColumn("kind", F.try_element_at(urls.segments(F.col("url")), F.lit(1)))
    short = [F.length("url"), "url", "page_id"]
    parts = [relational.top_per(p, ["host"], short, 1)] + [relational.top_per(p.filter(F.col("kind") == k), ["host"], short, n) for k, n in (("en", 8), ("fr", 3), ("de", 4))]
    every = None
    for n, part in enumerate(parts):
        one = part.select("host", "page_id", F.lit(n).alias("part"))
        every = one if every is None else every.unionByName(one)
    return relational.top_per(every.groupBy("host", "page_id").agg(F.min("part").alias("part")), ["host"], ["part", "page_id"], 10)


@query("G04_distinct_first_seen", "SELECT txt, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]*/[^/?#]*', 0) AS txt FROM pages) GROUP BY 1")
def distinct_first(spark, sf):
    p = _pages(spark, sf).select("page_id", F.regexp_extract("url", "^https?://[^/]*/[^/?#]*", 0).alias("txt"))
    return relational.first_per(p, ["txt"], ["page_id"])


@query("C03_page_outline", "SELECT s.page_id, o.title FROM pages s LEFT JOIN (SELECT url, min(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS title FROM pages GROUP BY url) o ON o.url = s.url")
def outline(spark, sf):
    p = _pages(spark, sf)
    titles = p.groupBy("url").agg(F.min(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("title"))
    sources = p.select("page_id", F.concat(F.lit("x"), "url").alias("final_url"), F.col("url").alias("own_url"))
    return relational.probed(sources, titles, ["final_url", "own_url"], "url", "title").select("page_id", "title")


@query("C01_source_usage", "SELECT p.page_id, coalesce(u.used, '') AS used FROM pages p LEFT JOIN (SELECT url, string_agg(DISTINCT use, ',' ORDER BY use) AS used FROM (SELECT url, 'k' || CAST(page_id % 3 AS VARCHAR) AS use FROM pages) GROUP BY url) u ON u.url = p.url")
def source_usage(spark, sf):
    p = _pages(spark, sf)
    used = p.select("url", F.concat(F.lit("k"), (F.col("page_id") % 3).cast("string")).alias("use"))
    per = relational.usage_of(p.select("url").distinct().withColumn("final_url", F.lit(None).cast("string")), used)
    return p.join(per, "url").select("page_id", F.array_join("used_as", ",").alias("used"))


@query("C05_C07_left_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled(spark, sf):
    return relational.left_over(_docs(spark, sf).select("doc_id"), spark.read.parquet(f"{sf}/labels.parquet"), ["doc_id"])


@query("C06_unplanned_capped", "SELECT doc_id FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 400")
def unplanned(spark, sf):
    rest = relational.left_over(_docs(spark, sf).select("doc_id"), spark.read.parquet(f"{sf}/labels.parquet"), ["doc_id"])
    return rest.orderBy("doc_id").limit(400)


@query("C08_semi_flags", "SELECT d.source, bool_or(l.quality = 1) AS read_ok, bool_or(l.quality = 0) AS unreadable, bool_or(l.doc_id IS NULL) AS failed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def semi_flags(spark, sf):
    j = _docs(spark, sf).select("doc_id", "source").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left")
    return j.groupBy("source").agg(F.bool_or(F.col("quality") == 1).alias("read_ok"), F.bool_or(F.col("quality") == 0).alias("unreadable"), F.bool_or(F.col("quality").isNull()).alias("failed"))


@query("G06_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(spark, sf):
    return _docs(spark, sf).select("doc_id").subtract(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"))


@query("C14_pattern_mentions", r"""
  SELECT d.doc_id, string_agg(n.name, ',' ORDER BY n.name) AS names FROM documents d
  JOIN (SELECT unnest(['the', 'sur', 'heit', 'para', 'other words']) AS name) n ON regexp_matches(lower(d.text), '(^|[^a-z0-9_])' || n.name || 's?([^a-z0-9_]|$)') GROUP BY 1""")
def pattern_mentions(spark, sf):
    names = spark.createDataFrame([(0, n) for n in ("the", "sur", "heit", "para", "other words")], "site_id int, name string")
    found = relational.mentions(_docs(spark, sf).select(F.lit(0).alias("site_id"), F.col("doc_id").alias("id"), "text"), names)
    return found.select(F.col("id").alias("doc_id"), F.array_join("names", ",").alias("names"))


@query("C15_vocabulary_theta", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)license') OR regexp_matches(text, '(?i)released under') OR regexp_matches(text, '(?i)copyright')")
def vocabulary(spark, sf):
    words = F.array(*[F.lit(w) for w in ("(?i)license", "(?i)released under", "(?i)copyright")])
    return _docs(spark, sf).filter(F.exists(words, lambda r: F.rlike("text", r))).select("doc_id", "lang")


@query("H28_sentences", rf"""
  SELECT doc_id, count(*) AS n, max(length(s)) AS longest FROM (
    SELECT doc_id, regexp_replace(regexp_replace(s, '[.!?]+$', ''), '^{_WS}+|{_WS}+$', '', 'g') AS s FROM (
      SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents)) WHERE s <> '' GROUP BY 1""")
def sentence_stats(spark, sf):
    s = _docs(spark, sf).select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


@query("H29_restrictions", r"SELECT doc_id, 0 AS n FROM documents WHERE NOT regexp_matches(text, '(?i)(^|[.!?]\s+)(do not|don.?t|never|avoid|nunca|no se debe|evit(a|á|ar)|no (uses?|usar))\s')")
def restriction_counts(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.size(text.restrictions(d.text)).alias("n"))


@query("D03_D18_ordered_union", "SELECT source, string_agg(lang, ',' ORDER BY first_seen) AS langs FROM (SELECT source, lang, min(doc_id) AS first_seen FROM documents GROUP BY 1, 2) GROUP BY 1")
def ordered_union(spark, sf):
    # One row for each distinct value first, so that a large source gathers values and not rows.
    seen = _docs(spark, sf).groupBy("source", "lang").agg(F.min("doc_id").alias("ord")).withColumn("langs", F.array("lang"))
    return relational.ordered_union(seen, ["source"], "langs", "ord", "u").select("source", F.array_join("u", ",").alias("langs"))


@query("D01_group_tabs", f"SELECT {_d_segments()}[1] AS grp, count(*) AS tabs, min(page_id) AS first_page FROM pages GROUP BY 1")
def group_tabs(spark, sf):
    p = _pages(spark, sf)
    return p.groupBy(F.try_element_at(urls.segments(p.url), F.lit(1)).alias("grp")).agg(F.count("*").alias("tabs"), F.min("page_id").alias("first_page"))


_HEAD = r"(?is)<h[1-4]([\s/][^>]*)?>.*?</h[1-4]\s*>"


@query("E07_H18_sections", f"""
  WITH x AS (SELECT page_id, regexp_extract_all(html, '{_HEAD}') AS heads, string_split_regex(html, '{_HEAD}') AS gaps FROM pages WHERE html IS NOT NULL),
  r AS (SELECT page_id, unnest(range(len(heads))) AS n, unnest(heads) AS head, unnest(gaps[2:]) AS after FROM x),
  l AS (SELECT *, CAST(substr(head, 3, 1) AS INTEGER) AS level FROM r),
  u AS (SELECT *, (SELECT min(b.n) FROM l b WHERE b.page_id = a.page_id AND b.n > a.n AND b.level <= a.level) AS upto FROM l a)
  SELECT u.page_id, u.n, u.level, any_value({_d_strip("regexp_replace(" + _d_strip("u.head") + ", '[#¶§]+', '', 'g')")}) AS title, CAST(sum(length(k.after) + CASE WHEN k.n > u.n THEN length(k.head) ELSE 0 END) AS BIGINT) AS chars
  FROM u JOIN l k ON k.page_id = u.page_id AND k.n >= u.n AND (u.upto IS NULL OR k.n < u.upto) GROUP BY 1, 2, 3""")
def page_sections(spark, sf):
    found = page_blocks.section_texts(_pages(spark, sf).select(F.col("page_id").alias("id"), "html"))
    return found.select(F.col("id").alias("page_id"), "n", "level", "title", F.length("html").cast("long").alias("chars"))


_LABELLED = r"(?is)<h1([\s/][^>]*)?>.*?</h1\s*>|<div([\s/][^>]*)?>.*?</div\s*>|<b([\s/][^>]*)?>.*?</b\s*>"


@query("E09_H17_labelled_paragraph", f"""
  WITH x AS (SELECT page_id, regexp_extract_all(html, '{_LABELLED}') AS own, string_split_regex(html, '{_LABELLED}') AS gaps FROM pages WHERE html IS NOT NULL),
  t AS (SELECT page_id, own, gaps, list_transform(own, lambda o: {_d_strip("o")}) AS texts FROM x),
  f AS (SELECT *, list_filter(range(1, len(own) + 1), lambda i: length(texts[i]) BETWEEN 1 AND 80)[1] AS i FROM t),
  r AS (SELECT page_id, texts[i] AS label, array_to_string(list_transform(range(i, len(own) + 1), lambda k: CASE WHEN k > i THEN own[k] ELSE '' END || gaps[k + 1]), '') AS rest FROM f WHERE i IS NOT NULL)
  SELECT page_id, label, nullif({_d_strip(r"regexp_extract(rest, '(?is)<p([\s/][^>]*)?>(.*?)</p\s*>', 2)")}, '') AS paragraph FROM r""")
def labelled_paragraph(spark, sf):
    """The paragraph after a page's first heading, box or bold text of at most 80 characters."""
    found = page_blocks.labelled(_pages(spark, sf).select(F.col("page_id").alias("id"), "html"), "(?s).+", ("h1", "div", "b"))
    return found.withColumnRenamed("id", "page_id")
