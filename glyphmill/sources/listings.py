"""Listings of a site's pages in stored bodies: (id, body) in, one row an address out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text, urls
from glyphmill.operators import relational

MAX_LISTED = 20_000


def locations(body: Column) -> Column:
    """The addresses of a sitemap or sitemap index, at most MAX_LISTED. Blocks are found in linear time."""
    clean = lambda x: F.trim(F.replace(F.regexp_replace(x, r"<!\[CDATA\[|\]\]>", ""), F.lit("&amp;"), F.lit("&")))
    return F.transform(F.slice(text.blocks(body, "loc"), 1, MAX_LISTED), clean)


def sitemap(docs: DataFrame) -> DataFrame:
    """(id, loc, is_index): at most MAX_LISTED addresses of each sitemap or sitemap index."""
    return docs.select("id", F.col("body").rlike(r"(?i)<sitemapindex[\s>]").alias("is_index"), F.explode(locations(F.col("body"))).alias("loc"))


def robots(docs: DataFrame) -> DataFrame:
    """(id, sitemap)"""
    found = docs.select("id", F.explode(F.split("body", r"\r?\n")).alias("line"))
    return found.select("id", F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*(\S+)", 1).alias("sitemap")).filter("sitemap <> ''")


def markdown_links(docs: DataFrame, base: Column) -> DataFrame:
    """(id, url): links and bare addresses of llms.txt, resolved, normalised and distinct, the first MAX_LISTED of a body."""
    raw = F.regexp_extract_all("body", F.lit(r"""\]\(\s*[^)\s]+\s*\)|https?://[^\s)<>"']+"""), F.lit(0))
    bare = F.transform(raw, lambda x: F.regexp_replace(x, r"^\]\(\s*|\s*\)$", ""))
    each = docs.select("id", base.alias("base"), F.posexplode(F.array_distinct(bare)).alias("ord", "raw"))
    found = each.select("id", "ord", urls.normalize(urls.resolve(F.col("raw"), F.col("base"))).alias("url")).filter("url IS NOT NULL")
    return relational.top_per(found.groupBy("id", "url").agg(F.min("ord").alias("ord")), ["id"], ["ord"], MAX_LISTED).select("id", "url")


def storybook(docs: DataFrame) -> DataFrame:
    """(id, name): the last parts of the titles of a Storybook index; a body that isn't one has none."""
    kind = "struct<entries:map<string,struct<title:string,kind:string>>,stories:map<string,struct<title:string,kind:string>>>"
    tree = F.from_json("body", kind)
    each = F.explode(F.map_values(F.coalesce(tree["entries"], tree["stories"])))
    title = F.coalesce(F.col("e.title"), F.col("e.kind"))
    return docs.select("id", each.alias("e")).select("id", F.trim(F.element_at(F.split(title, "/"), -1)).alias("name")).filter("name <> ''").distinct()


def docc_candidates(url: Column) -> Column:
    """Where the data of a DocC shell page may be, best first."""
    stem = F.regexp_replace(urls.path(url), "/+$", "")
    return F.array(*[F.concat(urls.origin(url), F.lit("/tutorials/data"), stem, F.lit(end)) for end in (".md", ".json")])
