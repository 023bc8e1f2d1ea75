"""Requests, frontiers, refills, and what reports let one say."""

import json
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import requests, text
from glyphmill.operators import frontier, reading, relational, scoring
from glyphmill.sources import site_documents
from tests.test_engine import one, scored, site


def test_alternatives_are_trimmed(spark):
    assert one(spark, text.allowed_values(F.col("t")), t="small | large | string") == ["small", "large"]


@pytest.mark.parametrize(
    ("form", "code", "field"),
    [(("https://a.com", 3, "", ""), None, None), (("", 3, "", ""), "MISSING_FIELD", "ds_url"), (("javascript:x", 3, "", ""), "INVALID_FIELD", "ds_url"), (("https://a.com", 9, "", ""), "MISSING_FIELD", "rating"),
     (("https://a.com", 3, "a b@c", ""), "INVALID_FIELD", "email"), (("", 3, "", "x"), "SPAM", None), ((None, None, None, None), "MISSING_FIELD", "ds_url")],
)
def test_feedback(spark, form, code, field):
    row = spark.createDataFrame([form], "u string, r int, e string, w string").select(requests.feedback(F.col("u"), F.col("r"), F.col("e"), F.col("w")).alias("x")).first().x
    assert (row.ok, row.code, row.field) == (code is None, code, field)


def test_request_codes(spark):
    assert one(spark, requests.client_ip(F.col("x"), F.lit("1.1.1.1"), F.lit(True)), x="9.9.9.9, 10.0.0.1") == "10.0.0.1"
    assert one(spark, requests.client_ip(F.col("x"), F.lit("1.1.1.1"), F.lit(False)), x="9.9.9.9") == "1.1.1.1"
    assert one(spark, requests.error_code(requests.entry_error(F.col("r"), F.lit(0)))["code"], r="HTTP 403") == "UNREACHABLE_REFUSED"
    assert one(spark, requests.entry_error(F.col("r"), F.lit(2)), r="HTTP 403") is None
    assert one(spark, requests.reason_key(F.col("r")), r="HTTP_410") == "srHttp404"
    assert one(spark, requests.used_text(F.array(F.lit("schema"), F.lit("?"))), z=1) == ["usedSchema"] and one(spark, requests.used_text(F.array().cast("array<string>")), z=1) == ["usedNothing"]


def refill_by_hand(planned, reserves):
    used, taken = dict.fromkeys(frontier.KINDS, 0), []
    for n in (1, 2, 3):
        failed = [k for _, k, f in planned if f] + [t[1] for t in taken if not t[2]]
        now = []
        for kind in frontier.KINDS:
            pool = sorted((o, u, ok) for o, u, k, ok in reserves if k == kind)
            for _ in range(failed.count(kind) - used[kind]):
                if used[kind] < len(pool) and len(taken) + len(now) < frontier.REPLACEMENTS:
                    _, u, ok = pool[used[kind]]
                    used[kind] += 1
                    now.append((u, kind, ok, n))
        taken += now
    return {(u, n) for u, _, _, n in taken}


@pytest.mark.parametrize("seed", range(4))
def test_refill(spark, seed):
    r = random.Random(seed)
    planned = [(f"p{i}", r.choice(frontier.KINDS), r.random() < 0.5) for i in range(16)]
    reserves = [(i, f"r{i}", r.choice(frontier.KINDS), r.random() < 0.6) for i in range(24)]
    p = spark.createDataFrame([("s", *x) for x in planned], "site_id string, url string, kind string, failed boolean")
    v = spark.createDataFrame([("s", *x) for x in reserves], "site_id string, ord int, url string, kind string, ok boolean")
    assert {(x.url, x.round) for x in frontier.refilled(p, v).collect()} == refill_by_hand(planned, reserves)


def test_plans(spark):
    narrow = spark.createDataFrame([("a", 0, "x"), ("b", 2, "y"), ("c", 0, "z")], "site_id string, components_found int, root string")
    wide = spark.createDataFrame([("a", 3, "X"), ("b", 9, "Y"), ("c", 0, "Z")], "site_id string, components_found int, root string")
    assert {r.site_id: (r.root, r.widened) for r in frontier.widened(narrow, wide).collect()} == {"a": ("X", True), "b": ("y", False), "c": ("z", False)}
    at = "https://a.com/components/button"
    links = spark.createDataFrame([("a", at, f"{at}/{t}", k) for k, t in enumerate(("usage", "code", "api", "props", "style", "design"))], "site_id string, page string, link string, ord int")
    chosen = spark.createDataFrame([("a", at), ("a", f"{at}/usage")], "site_id string, url string")
    assert [r.ord for r in frontier.tabs_to_read(links, chosen).orderBy("ord").collect()] == [1, 2, 3]
    found = spark.createDataFrame([("a", "sitemap", "u"), ("a", "llms.txt", "v"), ("b", "links", "w")], "site_id string, method string, url string")
    assert {(r.site_id, r.url) for r in frontier.listing(found).collect()} == {("a", "v"), ("b", "w")}
    said = [("a", "https://github.com/o/r/tree/x", "code", 0), ("a", "https://github.com/o/r", None, 1), ("a", "https://x.com/", "Our Storybook", 2), ("a", "https://x.com/y", "Home", 3)]
    kinds = frontier.official_sources(spark.createDataFrame(said, "site_id string, url string, label string, ord int")).orderBy("ord").collect()
    assert [(r.ord, r.kind) for r in kinds] == [(0, "repository"), (2, "storybook")]


def test_evidence_and_names(spark):
    rows = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, None)], "id long, ids array<string>")
    evidence = spark.createDataFrame([("x", None), ("y", "page")], "id string, source string")
    assert {r.id: r.source for r in relational.first_evidence(rows, "ids", evidence).collect()} == {1: "page", 2: None, 3: None}


def test_reading(spark):
    df, subs, dims, total = scored(spark, site(), site(site_id="empty", components=[], tokens_status="NOT_EVALUABLE", contradictions=[{"component": "a", "field": "b"}]))
    scores = scoring.dimension_scores(subs)
    sure = reading.reason_key(scoring.certainty(subs, True), "demo", True)
    read = reading.dimensions_read(sure, scores, True)
    meaning = {(r.site_id, r.dimension): r.meaning for r in read.collect()}
    assert meaning["s", "D1"] == "full" and meaning["s", "D3"] == "high" and meaning["empty", "D3"] == "low"
    can = {r.site_id: r for r in reading.capabilities(sure, read).collect()}
    assert can["s"].can == ["D1", "D2", "D3", "D4", "D5", "D6"] and can["s"].may_infer == ["api_consistency"] and can["s"].not_evaluated == ["D7"]
    assert can["empty"].not_evaluated == ["D2", "D3", "D4", "D5", "D6", "D7"]
    fix = {(r.site_id, r.dimension): r for r in reading.recommendations(sure, True).collect()}
    assert fix["s", "D3"].direct == ["api_consistency"] and fix["s", "D3"].possible == []
    totals = scoring.global_scores(scores)
    said = {r.site_id: r.limitations for r in reading.limitations(df, totals, scores, scoring.coverage_status(df)).collect()}
    assert said["s"] == ["D7:NOT_EVALUATED"] and said["empty"][-1] == "CONTRADICTIONS:1" and "LOW_COVERAGE:20" in said["empty"]
    why = {r.site_id: r.reasons for r in reading.incomplete_reasons(df, totals, sure, read).collect()}
    assert why["s"] == [] and why["empty"] == ["LOW_COVERAGE:20", "NOT_EVALUATED:D2,D3,D4,D5,D6"]


def test_site_documents(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(site(), indent=1))
    (tmp_path / "weights.json").write_text('{"weights": {"D1": 0.4, "D2": 0.6}}')
    (tmp_path / "off.json").write_text('{"weights": {"D1": 0.4}}')
    df = site_documents.demo(spark, str(tmp_path), "good")
    assert df.first().valid and scoring.report(df).first().shown == 100
    with pytest.raises(ValueError):
        site_documents.demo(spark, str(tmp_path), "../good")
    assert site_documents.weights(spark, str(tmp_path / "weights.json")).count() == 2
    with pytest.raises(Exception, match="add up to 1"):
        site_documents.weights(spark, str(tmp_path / "off.json")).collect()
    site_documents.write_reports(scoring.report(df), str(tmp_path / "out"), "demo")
    back = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert back["export_format_version"] == 1 and back["mode"] == "demo" and back["report"]["shown"] == 100
