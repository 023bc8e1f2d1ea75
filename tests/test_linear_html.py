"""Expressions on hostile pages: linear in the page, and the scanner's answers on pages of random tags."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import html_scan, text

UNITS = [
    "<p>", "<p ", "<h2>", "<h3>x</h3><p>", "<li>", "<td>", "<tr>", "<table>", "<pre>", "<script>", "<style>", "<nav>", "<header>", '<div role="navigation">',
    "<a href=x ", "<b>When to use</b>", "<loc>", "<", "<iframe ", "<time ", "<body>", "<nav></header>", "<script ", "</p ",
]
READERS = {
    "strip_tags": text.strip_tags, "visible_text": text.visible_text, "headings": text.headings, "code": text.code_blocks, "first": text.first_paragraph,
    "paragraphs": lambda h: text.blocks(h, "p"), "no_nav": lambda h: text.without_block(h, "nav"), "links": text.links, "demos": text.live_demos,
    "shell": lambda h: text.is_shell(F.lit("text/html"), h), "browser": lambda h: text.needs_browser(F.lit("text/html"), h),
}
SECONDS = 1.5


@pytest.mark.parametrize("name", READERS)
def test_hostile_pages_take_linear_time(spark, name):
    pages = {u: (u * (300_000 // len(u) + 1))[:300_000] for u in UNITS} | {"closed once": "<p>" * 99_000 + "</p>", "swallowed": "<script " * 37_000 + "</script>"}
    out = READERS[name](F.col("html")).cast("string").alias("o")
    frame = spark.createDataFrame([(html,) for html in pages.values()], "html string").repartition(8).cache()
    assert frame.select(F.max(F.length("html"))).first()[0] >= 297_000
    began = time.perf_counter()
    frame.select(F.length(out)).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    frame.unpersist()
    # All pages one after the other; a quadratic reader takes over ten seconds for each of several.
    assert took < SECONDS * len(pages)


def test_random_tags_read_as_the_scanner_reads_them(spark):
    rng = random.Random(8)
    parts = [
        "<p>", "</p>", "<P class=a>", "</P >", "<p ", ">", "<", "x", " y ", "<h1>", "</h1>", "<h2>", "</h2>", "<nav>", "</nav>", "<header>", "</header>", "<head>", "</head>",
        "<script>", "</script>", "<style>", "</style\n>", "<body>", "</body>", "<pre>", "</pre>", "&nbsp;", "<>", "<script ", "</nav", "<paragraph>", "é",
    ]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    own = [F.array_join(READERS[k](F.col("html")), "|") if k in ("headings", "code", "paragraphs") else READERS[k](F.col("html")) for k in ("strip_tags", "visible_text", "headings", "code", "paragraphs", "no_nav", "first")]
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", *own).collect()
    for k, *said in map(tuple, rows):
        html = pages[k]
        first = html_scan.find_blocks(html, "h[1-3]", 1)
        after = html_scan.find_blocks(html[first[0].end :] if first else html, "p", 1)
        want = [
            html_scan.strip_tags(html), html_scan.visible_text(html), "|".join(t for b in html_scan.find_blocks(html, "h[1-3]") if (t := html_scan.strip_tags(b.inner))),
            "|".join(html_scan.strip_tags(b.inner) for b in html_scan.find_blocks(html, "pre")), "|".join(b.inner for b in html_scan.find_blocks(html, "p")),
            html_scan.remove_blocks(html, "nav"), (html_scan.strip_tags(after[0].inner) or None) if after else None,
        ]
        assert said == want, html
