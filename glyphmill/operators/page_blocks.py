"""Places of blocks in pages as rows, and what lies between them: sections, labels with their paragraphs, rows of tables.

A page's text is split at its blocks by patterns that take linear time (``text.closed``); the lengths of the parts, summed in order,
are the places. What ends a section, and which paragraph comes first after a label, are found by windows over a page's
places, so no place is compared with all others. A page of any size is a group of its own rows; its text isn't repeated with each of them.

Edges: a null or empty page has no rows; a tag without a close is no block; rows of one id are one page, so ids are to be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text

# Fixed values.
HEADINGS = ("h1", "h2", "h3", "h4")
LABELS = ("h1", "h2", "h3", "h4", "h5", "h6", "span", "div", "dt", "strong", "b")
MAX_LABEL, MAX_TABLES, MAX_ROWS, MAX_VALUE = 80, 40, 300, 200


def _pattern(tags: tuple[str, ...]) -> str:
    return rf"(?is)<({'|'.join(tags)})(?=[\s/>])[^>]*>.*?</\1\s*>"


def _plain(value: Column) -> Column:
    return F.replace(value, F.lit(text.UNCLOSED), F.lit("<"))


def blocks(pages: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """pages (id, html): (id, n, start, block, after): blocks of some tags in order, from 0, where they start, and the text up to the next one."""
    h = text.closed(F.col("html"), *tags)
    parts = pages.filter("html IS NOT NULL").select("id", h.alias("h"))
    parts = parts.select("id", F.split("h", _pattern(tags), -1).alias("gaps"), F.regexp_extract_all("h", F.lit(_pattern(tags)), F.lit(0)).alias("own"))
    rows = parts.select("id", F.get("gaps", F.lit(0)).alias("lead"), F.posexplode(F.arrays_zip("own", F.slice("gaps", F.lit(2), F.size("own")).alias("after"))).alias("n", "x"))
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("id", F.col("n").cast("long").alias("n"), "lead", _plain(F.col("x.own")).alias("block"), _plain(F.col("x.after")).alias("after"))
    start = F.length("lead") + F.coalesce(F.sum(F.length("block") + F.length("after")).over(before), F.lit(0))
    return rows.withColumn("start", start.cast("long")).select("id", "n", "start", "block", "after")


def _inner(block: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(block, r"^<[^>]*>", ""), r"(?i)</[a-z0-9]+\s*>$", "")


def sections(pages: DataFrame, tags: tuple[str, ...] = HEADINGS) -> DataFrame:
    """pages (id, html): (id, n, level, title, upto): each heading, and the number of the next one of its level or above, which ends its section (null: the page's end does)."""
    rows = blocks(pages, tags).withColumn("level", F.substring("block", 3, 1).cast("int"))
    later = Window.partitionBy("id").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    levels = range(1, len(tags) + 1)
    ends = F.coalesce(*[F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("n"))).over(later)) for k in levels])
    title = text.collapse(F.regexp_replace(text.strip_tags(_inner(F.col("block"))), "[#¶§]+", ""))
    return rows.withColumn("upto", ends).withColumn("title", title).select("id", "n", "level", "title", "upto", "block", "after")


def section_texts(pages: DataFrame, tags: tuple[str, ...] = HEADINGS) -> DataFrame:
    """pages (id, html): (id, n, level, title, html): the sections with their HTML. A part of a page belongs to one section of each level at most, so it is repeated no more often."""
    rows = sections(pages, tags)
    rows = rows.withColumn("last", F.coalesce("upto", F.max("n").over(Window.partitionBy("id")) + 1) - 1)
    spans = rows.select("id", "n", "level", "title", F.explode(F.sequence("n", "last")).alias("k"))
    parts = rows.select(F.col("id").alias("_id"), F.col("n").alias("_k"), "block", "after")
    met = spans.join(parts, (F.col("id") == F.col("_id")) & (F.col("k") == F.col("_k")))
    piece = F.struct("k", F.when(F.col("k") > F.col("n"), F.concat("block", "after")).otherwise(F.col("after")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "")
    return met.groupBy("id", "n", "level", "title").agg(joined.alias("html"))


def labelled(pages: DataFrame, label: str, tags: tuple[str, ...] = LABELS) -> DataFrame:
    """pages (id, html): (id, label, paragraph) of the pages in which a short block's whole text matches label, a pattern: the first such block, and the first
    paragraph that opens after it (null: there is none, or it is empty).

    The marks of paragraphs are rows in order of their places; what comes first after a mark is a minimum over the rows behind it, and the first
    paragraph after a label's end is the least of a page's places from there on."""
    said = blocks(pages, tags).withColumn("label", text.strip_tags(_inner(F.col("block"))))
    said = said.filter((F.length("label") > 0) & (F.length("label") <= MAX_LABEL) & F.col("label").rlike(f"^(?:{label})$"))
    first = said.groupBy("id").agg(F.min_by(F.struct("label", (F.col("start") + F.length("block")).alias("end")), "n").alias("l")).select("id", "l.label", "l.end")
    own = pages.join(first.select("id"), "id", "left_semi")
    mark = r"(?i)<p(?=[\s/>])|</p\s*+>|>"
    parts = own.select("id", F.split("html", mark, -1).alias("gaps"), F.regexp_extract_all("html", F.lit(mark), F.lit(0)).alias("marks"))
    rows = parts.select("id", F.posexplode(F.arrays_zip("marks", F.slice("gaps", F.lit(1), F.size("marks")).alias("gap"))).alias("n", "x")).select("id", "n", "x.*")
    upto = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.length("gap") + F.length("marks")).over(upto)).withColumn("at", F.col("stop") - F.length("marks"))
    opens, closes = F.lower("marks") == "<p", F.startswith("marks", F.lit("</"))
    events = rows.select("id", "n", "at", opens.alias("opens"), F.when(closes, F.col("at")).alias("close"), F.when(~opens, F.col("stop")).alias("gt"))
    later = Window.partitionBy("id").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    events = events.withColumn("next_close", F.min("close").over(later))
    # An opening ends at the first > behind it, and its paragraph at the first close behind that.
    tag = F.min(F.when(F.col("gt").isNotNull(), F.struct("gt", "next_close"))).over(later)
    events = events.withColumn("tag", tag).filter(F.col("opens") & F.col("tag.next_close").isNotNull())
    after = events.join(first.select("id", "end"), "id").filter(F.col("at") >= F.col("end"))
    found = after.groupBy("id").agg(F.min(F.struct("at", F.col("tag.gt").alias("a"), F.col("tag.next_close").alias("b"))).alias("next"))
    said = text.strip_tags(F.expr("substring(html, next.a + 1, next.b - next.a)"))
    met = pages.join(first.select("id", "label"), "id").join(found, "id", "left")
    return met.select("id", "label", text.once(said, lambda t: F.when(t != "", t)).alias("paragraph"))


def tables(pages: DataFrame) -> DataFrame:
    """pages (id, html): (id, t, r, headers, cells): the rows of tables of two rows and more, behind their lower-case headers; what buttons say is no cell text."""
    some = F.slice(text.blocks(F.col("html"), "table"), 1, MAX_TABLES)
    t = pages.select("id", F.posexplode(some).alias("t", "table"))
    lines = F.slice(text.blocks(F.col("table"), "tr"), 1, MAX_ROWS)
    cells = lambda line: F.transform(text.blocks(line, "td", "th"), lambda c: text.strip_tags(text.without_block(c, "button")))
    t = t.select("id", "t", F.filter(F.transform(lines, cells), lambda c: F.size(c) > 0).alias("rows")).filter(F.size("rows") > 1)
    t = t.select("id", "t", F.transform(F.get("rows", F.lit(0)), F.lower).alias("headers"), F.posexplode(F.slice(F.col("rows"), F.lit(2), F.size("rows"))).alias("r", "cells"))
    return t.select("id", F.col("t").cast("long").alias("t"), F.col("r").cast("long").alias("r"), "headers", "cells")


def stacked_tokens(rows: DataFrame) -> DataFrame:
    """rows of ``tables``: (id, t, r, name, value): tokens whose name stands alone in a row, and the values in the next one."""
    filled = F.filter(F.transform("cells", text.collapse), lambda c: c != "")
    told = rows.filter(F.contains(F.array_join("headers", " "), F.lit("token"))).withColumn("_filled", filled)
    name = F.when((F.size("_filled") == 1) & text.is_token_name(F.get("_filled", F.lit(0))), F.get("_filled", F.lit(0)))
    w = Window.partitionBy("id", "t").orderBy("r")
    told = told.withColumn("name", name).withColumn("_next", F.lead("_filled").over(w)).withColumn("_after", F.lead("name").over(w))
    found = told.filter(F.col("name").isNotNull() & (F.size("_next") > 0) & F.col("_after").isNull())
    return found.select("id", "t", "r", "name", F.substring(F.array_join("_next", " "), 1, MAX_VALUE).alias("value"))
