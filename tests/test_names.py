"""Names of any number of words in texts, and sites whose pages are all read."""

from glyphmill.operators import detectors, relational
from glyphmill.plans import site_queries


def test_mentions_of_long_names(spark):
    pages = spark.createDataFrame([(1, 1, "Use a Date Range Picker With Presets, or buttons."), (1, 2, "Date range picker"), (1, 3, ""), (1, 4, None), (2, 5, "date range picker with presets")], "site_id int, id int, text string")
    names = spark.createDataFrame([(1, "Date Range Picker With Presets"), (1, "Button"), (1, "Date Range Picker")], "site_id int, name string")
    got = {r.id: r.names for r in relational.mentions(pages, names).collect()}
    assert got == {1: ["button", "date range picker", "date range picker with presets"], 2: ["date range picker"]}
    assert relational.mentions(pages, names.limit(0)).count() == 0


def test_mentions_are_literal(spark):
    import re

    texts = ["button, group of tabs", "button group", "buttons group", "my-tabs", "asp.net c++ xtab tab_s", "a date-picker and date pickers", "botón azul", None, "", "(x) +++ [y]"]
    names = ["button group", "Tab", "c++", ".net", "date-picker", "Botón", "+++", "[y]", "ab", "x.y", "button"]
    pages = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "site_id int, id int, text string")
    got = {r.id: r.names for r in relational.mentions(pages, spark.createDataFrame([(1, n) for n in names], "site_id int, name string")).collect()}
    want = {}
    for k, t in enumerate(texts):
        for n in sorted({n.lower().replace("-", " ").strip() for n in names}):
            if t and len(n) >= 3 and re.search(rf"\b{re.escape(n)}s?\b", t.lower(), re.A):
                want.setdefault(k, []).append(n)
    assert got == want and 0 not in [k for k, v in got.items() if "button group" in v]


def test_closing_tags_with_any_white_space():
    from glyphmill.functions import html_scan

    assert [b.inner for b in html_scan.find_blocks("<p>one</p" + " " * 500 + "><p>two</p\n>", "p")] == ["one", "two"]


def test_links_are_cut_after_repeats(spark, monkeypatch):
    from pyspark.sql import functions as F

    from glyphmill.sources import listings

    monkeypatch.setattr(listings, "MAX_LISTED", 3)
    body = "[a](/a) [a](/a) [a](/a) [b](/b) [a](/a) [c](/c) [d](/d)"
    docs = spark.createDataFrame([(1, body)], "id int, body string")
    got = {r.url for r in listings.markdown_links(docs, F.lit("https://s.example/llms.txt")).collect()}
    assert got == {f"https://s.example/{x}" for x in "abc"}


def test_sites_read_every_page_with_html(spark, tmp_path, monkeypatch):
    rows = [(k, f"https://a.example/p{k}", None if k == 3 else "<p>x</p>") for k in range(15)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(detectors, "sites", lambda read, records, files: (read, records))
    read, records = site_queries._sites(spark, str(tmp_path))
    assert {r.url for r in read.collect()} == {u for k, u, _ in rows if k != 3}
    assert [r.url for r in records.filter("status = 'FAILED'").collect()] == ["https://a.example/p3"] and records.count() == 15


def test_groups_are_summed_over_ranges(spark):
    import datetime

    rows = [(None if k % 11 == 0 else "ab"[k % 3 == 0], None if k % 7 == 0 else (k * 37) % 500, k, float(k % 5), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k * 37 % 500)) for k in range(1200)]
    df = spark.createDataFrame(rows, "g string, x int, id int, v double, t timestamp")
    for first in ("x", "v", "t", "id"):
        at = {"x": 1, "v": 3, "t": 4, "id": 2}[first]
        got = {r.id: (r._sofar, r._size) for r in relational.in_ranges(df, ["g"], [first, "id"], ranges=16).collect()}
        for g in (None, "a", "b"):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[at] is not None, r[at] if r[at] is not None else 0, r[2]))
            assert [got[r[2]] for r in own] == [(n + 1, len(own)) for n in range(len(own))]
    assert relational.in_ranges(df.limit(0), ["g"], ["x"]).count() == 0


def test_repetition_of_names(spark):
    from pyspark.sql import functions as F

    from glyphmill.operators import scoring

    rows = [["a"], ["a", "a"], ["a", "b", "a", "c"], [], ["x", None, "x", None, None], [None], ["b", "a", "c"]]
    got = [r.v for r in spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, names array<string>").orderBy("k").select(scoring.repetition(F.col("names")).alias("v")).collect()]
    want = [None if not r else sum(n is None or r.count(n) > 1 for n in r) / len(r) for r in rows]
    assert got == want
