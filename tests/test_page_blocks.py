"""Sections, labelled paragraphs and tables as rows, against the scanner on pages of random and hostile tags."""

import random
import re

from pyspark.sql import functions as F

from glyphmill.functions import html_scan
from glyphmill.operators import page_blocks

PARTS = [
    "<h1>", "</h1>", "<h2 a=b>", "</h2 >", "<H3>", "</h3>", "<h4>", "</h4>", "<p>", "<p class=x", "</p>", "<b>", "</b>", "<div>", "</div>", "<span>", "</span>", "use", "When", " x ", "#", ">", "<", "é", "&nbsp;", "<paragraph>",
]
HOSTILE = ["<h2>" * 3000, "<h1></h1>" * 700 + "<h4>", "<b>use</b>" * 500 + "<p>" * 3000, "<p " * 3000 + "<b>use</b>" + "<p " * 3000 + "</p>", None, "", "x" * 5000]


def frame(spark, seed, n):
    r = random.Random(seed)
    pages = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)] + HOSTILE
    return pages, spark.createDataFrame(list(enumerate(pages)), "id int, html string")


def test_sections(spark):
    pages, df = frame(spark, 1, 900)
    got = {}
    for r in page_blocks.section_texts(df).collect():
        got.setdefault(r.id, []).append((r.n, (r.level, r.title, r.html)))
    for k, html in enumerate(pages):
        assert [x for _, x in sorted(got.get(k, []))] == html_scan.sections(html), html


def test_first_paragraph_after_a_label(spark):
    pages, df = frame(spark, 2, 1500)
    got = {r.id: r.paragraph for r in page_blocks.labelled(df, "(?i)use|when x").collect()}
    label = re.compile("use|when x", re.I)
    for k, html in enumerate(pages):
        blocks = [html_scan.strip_tags(b.inner) for b in html_scan.find_blocks(html, "h[1-6]|span|div|dt|strong|b")]
        assert (k in got) == any(label.fullmatch(t) for t in blocks), html
        assert got.get(k) == html_scan.labelled_section(html, lambda t: bool(label.fullmatch(t))), html
    assert sum(v is not None for v in got.values()) > 3


def test_tables_and_stacked_tokens(spark):
    r = random.Random(3)
    cells = ["color.bg", "$gap", "x", "", "<b>space.s</b>", "a b", "<button>copy</button>4px", "colorFg", " "]
    row = lambda n: "<tr>" + "".join(f"<t{k}>{r.choice(cells)}</t{k}>" for k in [r.choice("dh") for _ in range(n)]) + r.choice(["</tr>", "</tr>", ""])
    pages = ["".join(f"<table><tr><th>{r.choice(['Token', 'Name'])}</th><th>Rest</th></tr>" + "".join(row(r.randint(0, 3)) for _ in range(r.randint(0, 7))) + r.choice(["</table>", ""]) for _ in range(r.randint(0, 3))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate([*pages, None])), "id int, html string")
    rows = page_blocks.tables(df).cache()
    got, tokens = {}, {}
    for x in rows.orderBy("id", "t", "r").collect():
        got.setdefault(x.id, {}).setdefault(x.t, (x.headers, []))[1].append(x.cells)
    for x in page_blocks.stacked_tokens(rows).orderBy("id", "t", "r").collect():
        tokens.setdefault(x.id, []).append((x.name, x.value, None))
    for k, html in enumerate(pages):
        want = html_scan.tables(html)
        assert list(got.get(k, {}).values()) == want, html
        assert tokens.get(k, []) == [t for h, lines in want if any("token" in c for c in h) for t in html_scan._stacked_tokens(lines)], html
    assert tokens
