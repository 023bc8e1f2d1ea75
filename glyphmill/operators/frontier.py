"""Which pages of a stored link table are read, under limits of depth, pages and time; replacements of failed ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import urls
from glyphmill.operators import relational

# Fixed values.
KINDS = ("tokens", "component", "pattern", "pattern_index", "changelog")
MAX_DEPTH, MAX_PAGES, MAX_TABS, MAX_TOKEN_TABS, MAX_OFFICIAL = 3, 40, 5, 2, 10
ROUNDS, REPLACEMENTS, CHILD_SITEMAPS = 3, 12, 6


def by_depth(pages: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """Adds status: what lies deeper than most is out of scope."""
    return pages.withColumn("status", F.when(F.col("depth") > most, "OUT_OF_SCOPE").otherwise("PENDING"))


def within_budget(rows: DataFrame, keys: list[str], order: list[str], pages: int, millis: int, extra: int = 0, starts: str | None = None) -> DataFrame:
    """Adds inside, limited and time_limited: a row is read while fewer than pages rows came before it, in less than millis (ms). The first row
    that is read with starts set lengthens the time by extra, once, for the rows after it.

    Only the first pages rows of a group can be inside, and Spark keeps no more of a group before it shuffles; what they say, the last row inside
    and the last one that counts, is joined to all rows. The order's columns tell rows of a group apart."""
    place = F.struct(*order)
    w = Window.partitionBy(*keys).orderBy(*order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    first = relational.top_per(rows, keys, order, pages).withColumn("_spent", F.coalesce(F.sum("ms").over(earlier), F.lit(0)))
    opens = (F.col("_spent") < millis) & F.coalesce(F.col(starts), F.lit(False)) if starts else F.lit(False)
    longer = F.coalesce(F.bool_or("_opens").over(earlier), F.lit(False))
    read = first.withColumn("_opens", opens).withColumn("_read", F.col("_spent") < F.when(longer, millis + extra).otherwise(millis))
    ends = read.groupBy(*keys).agg(F.max(F.when(F.col("_read"), place)).alias("_inside"), F.max(place).alias("_counted"))
    ends = ends.select(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)], "_inside", "_counted")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)])
    inside = F.coalesce(place <= F.col("_inside"), F.lit(False))
    out = rows.join(ends, same).withColumn("inside", inside).withColumn("limited", ~F.col("inside"))
    return out.withColumn("time_limited", F.col("limited") & (place <= F.col("_counted"))).drop("_inside", "_counted", *[f"_key{n}" for n in range(len(keys))])


def limits_reached(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What ``within_budget`` says of each group: (keys, crawl_limited, time_limited)."""
    return rows.groupBy(*keys).agg(F.bool_or("limited").alias("crawl_limited"), F.bool_or("time_limited").alias("time_limited"))


def reached(links: DataFrame, entries: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """(site_id, url, depth) of all that links (site_id, src, dst) reach from entries (site_id, url) in at most most steps.

    Each step joins the last step's new pages only; the number of steps is fixed, so the plan is one job."""
    step = entries.select("site_id", "url").distinct().withColumn("depth", F.lit(0))
    every = step
    edges = links.select("site_id", F.col("src").alias("url"), "dst").distinct()
    for depth in range(1, most + 1):
        ahead = edges.join(step.select("site_id", "url"), ["site_id", "url"], "left_semi").select("site_id", F.col("dst").alias("url")).distinct()
        step = ahead.join(every.select("site_id", "url"), ["site_id", "url"], "left_anti").withColumn("depth", F.lit(depth))
        every = every.unionByName(step)
    return every


def refilled(planned: DataFrame, reserves: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Replacements: reserves (site_id, kind, url, ord, ok) for planned (site_id, url, kind, failed).

    In each of ROUNDS rounds every kind takes as many reserves, in order, as it has failures not made up for, those of reserves
    taken before included, and REPLACEMENTS in all. Adds the round to what is taken."""
    keys = keys or ["site_id"]
    ranked = reserves.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("ord")))
    failed = planned.groupBy(*keys, "kind").agg(F.count_if("failed").alias("need"))
    place = F.lit(len(KINDS))
    for k, kind in enumerate(KINDS):
        place = F.when(F.col("kind") == kind, k).otherwise(place)
    pool = ranked.filter(F.col("kind").isin(*KINDS)).join(failed, [*keys, "kind"]).withColumn("place", place)
    taken = None
    for n in range(1, ROUNDS + 1):
        # A kind's need so far: its planned failures and those among its reserves taken in earlier rounds.
        rest = pool if taken is None else pool.join(taken.select(*keys, "url"), [*keys, "url"], "left_anti")
        before = [] if taken is None else [taken.groupBy(*keys, "kind").agg(F.count("*").alias("used"), F.count_if(~F.col("ok")).alias("lost")), taken.groupBy(*keys).agg(F.count("*").alias("all"))]
        for side, on in zip(before, ([*keys, "kind"], keys), strict=False):
            rest = rest.join(side, on, "left")
        used, lost, total = (F.coalesce(c, F.lit(0)) if before else F.lit(0) for c in ("used", "lost", "all"))
        due = rest.filter((F.col("rn") > used) & (F.col("rn") <= F.col("need") + lost)).withColumn("so_far", total)
        w = Window.partitionBy(*keys).orderBy("place", "rn")
        now = due.withColumn("q", F.row_number().over(w)).filter(F.col("so_far") + F.col("q") <= REPLACEMENTS)
        now = now.select(*keys, "kind", "url", "ok", F.lit(n).alias("round"))
        taken = now if taken is None else taken.unionByName(now)
    return taken


def child_sitemaps(listed: DataFrame) -> DataFrame:
    """listed (site_id, url, ord): at most CHILD_SITEMAPS a site, those that look like documentation first."""
    rank = F.when(F.col("url").rlike("(?i)doc|design|component|page"), 0).otherwise(1)
    return relational.top_per(listed, ["site_id"], [rank, "ord"], CHILD_SITEMAPS)


def widened(narrow: DataFrame, wide: DataFrame, found: str = "components_found") -> DataFrame:
    """One plan a site: that of the inferred root, or that of the whole host where only the latter has components."""
    w = wide.select("site_id", *[F.col(c).alias(f"_w_{c}") for c in wide.columns if c != "site_id"])
    swap = F.coalesce((F.col(found) == 0) & (F.col(f"_w_{found}") > 0), F.lit(False))
    j = narrow.join(w, "site_id", "left").withColumn("widened", swap)
    return j.select("site_id", "widened", *[F.when(F.col("widened"), F.col(f"_w_{c}")).otherwise(F.col(c)).alias(c) for c in narrow.columns if c != "site_id"])


def tabs_to_read(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """links (site_id, page, link, ord) that are further tabs of chosen (site_id, url) components, five a component with those chosen;
    and the token tabs of foundation pages, two a site."""
    same = urls.same_host(F.col("link"), F.col("page"))
    new = links.filter(same).join(chosen.select("site_id", F.col("url").alias("link")), ["site_id", "link"], "left_anti")
    own = chosen.filter(urls.is_component_page(F.col("url"))).groupBy("site_id", urls.component_identity(F.col("url")).alias("identity")).agg(F.count("*").alias("have"))
    tab = urls.is_component_page(F.col("page")) & urls.is_component_page(F.col("link")) & (urls.component_identity(F.col("page")) == urls.component_identity(F.col("link")))
    tabs = relational.first_per(new.filter(tab).withColumn("identity", urls.component_identity(F.col("link"))), ["site_id", "link"], ["ord"])
    rn = F.row_number().over(Window.partitionBy("site_id", "identity").orderBy("ord"))
    tabs = tabs.join(own, ["site_id", "identity"]).withColumn("rn", rn).filter(F.col("rn") + F.col("have") <= MAX_TABS).select("site_id", "link", "ord")
    token = (urls.classify(F.col("page")) == "tokens") & urls.is_design_token(F.col("link")) & urls.is_token_tab(F.col("link"), F.col("page"))
    tokens = relational.top_per(relational.first_per(new.filter(token), ["site_id", "link"], ["ord"]), ["site_id"], ["ord"], MAX_TOKEN_TABS)
    return tabs.unionByName(tokens.select("site_id", "link", "ord"))


def listing(found: DataFrame) -> DataFrame:
    """found (site_id, method, url): the listing of the best method a site has, and how each was answered."""
    rank: Column = F.lit(9)
    for k, name in enumerate(("llms.txt", "sitemap", "navigation", "links")):
        rank = F.when(F.col("method") == name, k).otherwise(rank)
    best = found.groupBy("site_id").agg(F.min_by("method", rank).alias("method"))
    return found.join(best, ["site_id", "method"], "left_semi").dropDuplicates(["site_id", "method", "url"])


def official_sources(links: DataFrame) -> DataFrame:
    """links (site_id, url, label, ord): declared external sources by address or else by label, one a key, MAX_OFFICIAL a site."""
    kind = F.coalesce(urls.official_kind(F.col("url")), urls.label_kind(F.col("label")))
    rows = links.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("key", urls.official_key(F.col("url"), F.col("kind")))
    return relational.top_per(relational.first_per(rows, ["site_id", "key"], ["ord"]), ["site_id"], ["ord"], MAX_OFFICIAL)


def source_rows(parts: list[DataFrame]) -> DataFrame:
    """The source log of several stages of (site_id, url, role, status, reason), earlier stages first."""
    return reduce(DataFrame.unionByName, [p.withColumn("stage", F.lit(k)) for k, p in enumerate(parts)])


def sitemap_walk(candidates: DataFrame, bodies: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the sitemaps of stored bodies list, indexes followed to their children.

    candidates (site_id, url, ord), bodies (site_id, url, body) and roots (site_id, root): (site_id, url), the pages listed, distinct and normalised, and
    (site_id, url, ord, status), the files in the order in which they are read: READ, NOT_A_SITEMAP or MISSING.

    Files are read first in, first out. A site follows CHILD_SITEMAPS children in all, those of its own host, and of one index those that look like documentation
    first; one that was read before still counts, but isn't read again, so cycles end. With so few children a walk has at most as many rounds, and only a site's few
    pending files go from round to round."""
    from glyphmill.session import cut
    from glyphmill.sources import listings

    texts = bodies.select("site_id", "url", F.coalesce("body", F.lit("")).alias("body"), F.xxhash64("site_id", "url").alias("id"))
    texts = relational.first_per(texts, ["site_id", "url"], ["body"])
    known = texts.select("site_id", "url", F.struct(F.col("body").rlike(r"(?i)<(urlset|sitemapindex)[\s>]").alias("sitemap"), F.col("body").rlike(r"(?i)<sitemapindex[\s>]").alias("index")).alias("is"), listings.locations(F.col("body")).alias("locs"))
    known = cut(known)
    status = F.when(F.col("is").isNull(), "MISSING").when(F.col("is.sitemap"), "READ").otherwise("NOT_A_SITEMAP")
    site = Window.partitionBy("site_id")
    pending = relational.first_per(candidates.select("site_id", "url", "ord"), ["site_id", "url"], ["ord"])
    pending = pending.select("site_id", "url", F.row_number().over(site.orderBy("ord")).cast("long").alias("ord"), F.lit(0).cast("long").alias("used"))
    read = None
    for _ in range(CHILD_SITEMAPS + 1):
        if read is not None:
            pending = pending.join(read.select("site_id", "url"), ["site_id", "url"], "left_anti")
        now = cut(pending.join(known.select("site_id", "url", "is"), ["site_id", "url"], "left").select("site_id", "url", "ord", "used", status.alias("status")))
        if now.isEmpty():
            break
        step = now.select("site_id", "url", "ord", "status")
        read = step if read is None else read.unionByName(step)
        kids = now.filter("status = 'READ'").join(known.filter("is.index").select("site_id", "url", "locs"), ["site_id", "url"]).join(roots, "site_id")
        kids = kids.select("site_id", "root", "url", "ord", "used", F.posexplode("locs").alias("n", "loc"))
        kids = kids.withColumn("kid", urls.normalize(urls.resolve(F.col("loc"), F.col("url")))).filter(urls.same_host(F.col("kid"), F.col("root")))
        rank = F.when(F.col("kid").rlike("(?i)doc|design|component|page"), 0).otherwise(1)
        # Of a site, no more children than are left are taken, so no more are sorted.
        taken = relational.top_per(kids.withColumn("rank", rank), ["site_id"], ["ord", "rank", "n"], CHILD_SITEMAPS)
        place = F.row_number().over(site.orderBy("ord", "rank", "n"))
        taken = taken.withColumn("place", place).filter(F.col("place") + F.col("used") <= CHILD_SITEMAPS)
        # All of a site's pending files carry how many children it has followed.
        taken = taken.select("site_id", F.col("kid").alias("url"), (1_000_000 + F.col("used") + F.col("place")).cast("long").alias("ord"), (F.col("used") + F.count("*").over(site)).alias("used"))
        pending = relational.first_per(taken, ["site_id", "url"], ["ord"])
    if read is None:
        read = now.select("site_id", "url", "ord", "status")
    listed = read.filter("status = 'READ'").join(known.filter("NOT is.index"), ["site_id", "url"]).select("site_id", "url", F.explode("locs").alias("loc"))
    pages = listed.select("site_id", urls.normalize(urls.resolve(F.col("loc"), F.col("url"))).alias("url")).filter("url IS NOT NULL").distinct()
    return pages, read
