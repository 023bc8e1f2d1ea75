"""Budgets of pages and time with a one-off extension, against a plain loop."""

import random

import pytest

from glyphmill.operators import frontier


def by_hand(rows, pages, millis, extra):
    out, deadline, spent, n, extended, over = {}, millis, 0, 0, False, False
    for k, ms, starts in rows:
        inside = n < pages and spent < deadline
        out[k] = (inside, not inside and n < pages)
        if inside and starts and not extended:
            extended, deadline = True, deadline + extra
        # A loop stops at the first row outside; the others are outside for the same reason or for the number of pages.
        spent += ms
        n += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_budgets(spark, seed):
    r = random.Random(seed)
    sites = {s: [(k, r.randrange(0, 500), r.random() < 0.2 if s != "none" else None) for k in range(r.randint(1, 30))] for s in ["a", "b", "none", *"cdefgh"]}
    sites["late"] = [(0, 1000, False), (1, 5, True), (2, 5, True)]  # the extension comes too late, so it isn't made
    sites["once"] = [(0, 900, True), (1, 900, True), (2, 900, True), (3, 900, False)]
    frame = spark.createDataFrame([(s, *row) for s, rows in sites.items() for row in rows], "site_id string, k int, ms long, starts boolean")
    got = {(x.site_id, x.k): (x.inside, x.time_limited) for x in frontier.within_budget(frame, ["site_id"], ["k"], 12, 1000, 700, "starts").collect()}
    assert got == {(s, k): v for s, rows in sites.items() for k, v in by_hand(rows, 12, 1000, 700).items()}
    assert [got["once", k][0] for k in range(4)] == [True, True, False, False] and got["late", 1] == (False, True)
    limits = {x.site_id: (x.crawl_limited, x.time_limited) for x in frontier.limits_reached(frontier.within_budget(frame, ["site_id"], ["k"], 12, 1000), ["site_id"]).collect()}
    assert limits == {s: (any(not v[0] for v in h.values()), any(v[1] for v in h.values())) for s, rows in sites.items() for h in [by_hand([(k, ms, False) for k, ms, _ in rows], 12, 1000, 0)]}


def test_plan_keeps_only_what_counts(spark):
    frame = spark.range(100).selectExpr("id % 3 AS site_id", "id AS k", "id AS ms")
    plan = frontier.within_budget(frame, ["site_id"], ["k"], 12, 1000)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
