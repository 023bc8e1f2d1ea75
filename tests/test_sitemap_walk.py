"""Nested sitemap indexes over stored bodies against a plain queue."""

import random

import pytest

from glyphmill.functions import html_scan
from glyphmill.operators import frontier


def locs(body):
    return [b.inner.replace("<![CDATA[", "").replace("]]>", "").replace("&amp;", "&").strip() for b in html_scan.find_blocks(body, "loc")]


def by_hand(candidates, bodies, host):
    pending, left, seen, pages, log = list(dict.fromkeys(candidates)), frontier.CHILD_SITEMAPS, set(), set(), []
    while pending:
        url = pending.pop(0)
        if url in seen:
            continue
        seen.add(url)
        body = bodies.get(url)
        if body is None:
            log.append((url, "MISSING"))
        elif "<urlset" not in body and "<sitemapindex" not in body:
            log.append((url, "NOT_A_SITEMAP"))
        else:
            log.append((url, "READ"))
            if "<sitemapindex" not in body:
                pages |= set(locs(body))
            else:
                own = [k for k in locs(body) if k.startswith(f"https://{host}/")]
                for k in sorted(own, key=lambda k: not any(w in k for w in ("doc", "design", "component", "page"))):
                    if left <= 0:
                        break
                    left -= 1
                    pending.append(k)
    return pages, log


def index(urls):
    return "<sitemapindex >" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def urlset(urls):
    return "<urlset >" + "".join(f"<url><loc><![CDATA[{u}]]></loc></url>" for u in urls) + "</urlset>"


@pytest.mark.parametrize("seed", range(2))
def test_walks(spark, seed):
    rng = random.Random(seed)
    sites = {}
    for k in range(12):
        host = f"s{k}.com"
        names = [f"https://{host}/{w}{i}.xml" for i, w in enumerate(rng.choices(["map", "docs", "design", "x"], k=8))] + ["https://other.com/doc.xml"]
        bodies = {n: rng.choice([index(rng.sample(names, 4)), urlset([f"https://{host}/p{rng.randrange(9)}" for _ in range(3)]), "<html></html>"]) for n in names[:7] + names[8:]}
        bodies[names[0]] = index(rng.sample(names, 5))  # often leads back to itself
        sites[host] = (rng.sample(names[:3], 2) + [names[0]], bodies)
    sites["none.com"] = ([], {})
    candidates = spark.createDataFrame([(h, u, n) for h, (c, _) in sites.items() for n, u in enumerate(c)], "site_id string, url string, ord int")
    bodies = spark.createDataFrame([(h, u, b) for h, (_, bs) in sites.items() for u, b in bs.items()], "site_id string, url string, body string")
    roots = spark.createDataFrame([(h, f"https://{h}/") for h in sites], "site_id string, root string")
    pages, read = frontier.sitemap_walk(candidates, bodies, roots)
    got = {}
    for r in read.orderBy("site_id", "ord").collect():
        got.setdefault(r.site_id, []).append((r.url, r.status))
    want = {h: by_hand(c, bs, h) for h, (c, bs) in sites.items()}
    assert got == {h: log for h, (_, log) in want.items() if log}
    assert {(r.site_id, r.url) for r in pages.collect()} == {(h, u) for h, (p, _) in want.items() for u in p}


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    pages, read = frontier.sitemap_walk(none("site_id string, url string, ord int"), none("site_id string, url string, body string"), none("site_id string, root string"))
    assert pages.collect() == [] and read.collect() == []
