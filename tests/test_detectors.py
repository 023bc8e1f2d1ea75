"""From the pages of a small site to its normalised document and score."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import html_scan
from glyphmill.operators import detectors, scoring

PAD = "<div>" + "lorem ipsum dolor " * 15 + "</div>"


def page(body: str) -> str:
    return f"<html><body>{body}{PAD}</body></html>"


BUTTON = page(
    "<h1>Button</h1><p>A button starts an action.</p><h2>When to use</h2><p>To start an action on the page.</p><p>Use a link instead. Never nest two buttons here.</p>"
    "<h2>Variants</h2><ul><li>Primary: main</li></ul><h2>States</h2><p>Hover and focus.</p><pre>x</pre>"
)
BUTTON_API = page("<h1>Button API</h1><table><tr><th>Name</th><th>Type</th></tr><tr><td>variant</td><td>'ghost' | 'solid'</td></tr><tr><td>size</td><td>string</td></tr></table>")
COLOR = page("<h1>Color</h1><table><tr><th>Token</th><th>Value</th><th>Use</th></tr><tr><td>color.bg</td><td>#fff</td><td>page</td></tr><tr><td>color.fg</td><td>var(--x)</td><td>text</td></tr></table>")
FORMS = page("<h1>Forms</h1><p>Put the button last.</p><h2>Layout</h2><p>One column.</p>")


@pytest.fixture(scope="module")
def site(spark):
    at = "https://a.com"
    rows = [("a", at + u, "text/html", b, False) for u, b in (("/components/button/", BUTTON), ("/components/button/api", BUTTON_API), ("/components/card", "<html></html>"), ("/foundations/color", COLOR), ("/patterns/forms", FORMS))]
    pages = spark.createDataFrame([*rows, ("b", "https://b.com/", "text/html", page("<h1>Hi</h1>"), False)], "site_id string, url string, content_type string, body string, rendered boolean")
    more = [("a", at + "/components/tabs/usage", "FAILED"), ("a", at + "/components/tabs/code", "FAILED"), ("a", at + "/components/button/code", "FAILED"), ("a", at + "/llms.txt", "CRAWLED")]
    records = pages.select("site_id", "url", F.lit("CRAWLED").alias("status")).unionByName(spark.createDataFrame(more, "site_id string, url string, status string"))
    files = spark.createDataFrame([(1, "a", '{"color": {"bg": {"$value": "#fff"}}, "space": {"s": {"$value": 4}}}'), (2, "a", "not json")], "id long, site_id string, body string")
    return detectors.sites(pages, records, files)


def test_site_document(site):
    rows = {r.site_id: r for r in site.collect()}
    by = {c.name: c for c in rows["a"].components}
    assert set(by) == {"Button", "card", "tabs"}
    b = by["Button"]
    assert (b.description, b.usage.purpose) == ("A button starts an action.",) * 2 and b.usage.when_to_use == "To start an action on the page."
    assert b.usage.competing_components == ["link"] and b.usage.restrictions == ["Never nest two buttons here"]
    assert [(p.name, p.allowed_values) for p in b.props] == [("variant", ["ghost", "solid"]), ("size", [])]
    assert b.variants == ["Primary", "ghost", "solid"] and {s.name for s in b.states} == {"hover", "focus"} and b.code_examples_count == 1
    assert by["card"].evaluation_status == by["tabs"].evaluation_status == "NOT_EVALUABLE"
    assert {(t.name, t.origin, t.intent, t.category) for t in rows["a"].tokens} == {("color.bg", "json", "page", "primitive"), ("space.s", "json", None, "primitive"), ("color.fg", "html_table", "text", "semantic")}
    assert [(p.name, p.components, p.layout) for p in rows["a"].patterns] == [("Forms", ["button"], "section")]
    a = rows["a"].access
    assert a.documentation_recoverability == "MOSTLY_RECOVERABLE" and a.agent_manifest == "COMPLETE" and a.props_types_accessibility == "PARTIAL" and a.structured_tokens == "PARTIAL"
    assert rows["a"].tokens_status == "FOUND" and rows["b"].tokens_status == "NOT_EVALUABLE" and rows["b"].components == []
    assert rows["a"].criteria["D4.disambiguation"].status == "OUT_OF_SCOPE" and rows["b"].criteria["D1.structured_tokens"].reason == "NOT_LOOKED"
    assert rows["a"].documentation.components_documented == 1 and rows["a"].coverage.components_detected == 3


def test_site_report(site):
    got = {r.site_id: r for r in scoring.report(site).collect()}
    assert got["a"].score is not None and got["a"].shown % 5 == 0
    assert {f.rule for f in got["a"].findings} >= {"EXCLUDED"}


@pytest.mark.parametrize(
    ("sentence", "name"),
    [("Use a link instead", "link"), ("Pick tabs instead of the side menu when short", "side menu"), ("En lugar de una casilla usa esto", "casilla usa esto"), ("Use it", None), ("Instead of when", None)],
)
def test_competitor(sentence, name):
    assert html_scan.competitor(sentence) == name


def test_probe(spark):
    answers = [("a", 200, "text/plain", "# Docs"), ("a", 404, None, None), ("b", 200, "text/html", "<html>"), ("b", 404, None, None), ("c", 500, None, None)]
    df = spark.createDataFrame(answers, "site_id string, http_status int, content_type string, body string")
    assert {r.site_id: r.llms_txt for r in detectors.probe(df).collect()} == {"a": "FOUND", "b": "ABSENT", "c": "UNKNOWN"}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "site_id string, url string, content_type string, body string, rendered boolean")
    records = spark.createDataFrame([], "site_id string, url string, status string")
    files = spark.createDataFrame([], "id long, site_id string, body string")
    assert scoring.report(detectors.sites(pages, records, files)).count() == 0


def test_evidence_is_numbered_and_linked(site):
    row = next(r for r in site.collect() if r.site_id == "a")
    ids = {c.name: c.evidence_ids for c in row.components}
    # Purpose, when to use, a restriction, a rule, two props, variants and two states of the button; a blank row of what could not be read.
    assert len(ids["Button"]) >= 8 and len(ids["card"]) == len(ids["tabs"]) == 1
    every = [x for own in ids.values() for x in own]
    assert sorted(every) == [f"ev-{k:04d}" for k in range(1, len(every) + 1)]
    found = {r.site_id: r for r in scoring.report(site).collect()}["a"].findings
    assert found and all(f.evidence == ids.get(f.component, []) for f in found)


def test_evidence_rows_by_their_rules(spark):
    at = "https://a.com"
    gallery = page("<h1>Gallery</h1><h2>Anatomy</h2><p>A frame, a picture and a caption below it.</p><nav>Uses the button</nav>")
    bodies = [("/components/button/", BUTTON), ("/components/button/api", BUTTON_API), ("/components/card", "<html></html>"), ("/foundations/color", COLOR), ("/patterns/gallery", gallery), ("/patterns/none", "<p>short</p>")]
    pages = spark.createDataFrame([("a", at + u, "text/html", b, False) for u, b in bodies], "site_id string, url string, content_type string, body string, rendered boolean")
    records = pages.select("site_id", "url", F.lit("CRAWLED").alias("status"))
    files = spark.createDataFrame([(1, "a", at + "/tokens.json", '{"color": {"bg": {"$value": "#fff"}}, "gap": "4px"}')], "id long, site_id string, url string, body string")
    seen = detectors.read(pages)
    comps, toks = detectors.components(seen, records), detectors.tokens(seen, files)
    pats = detectors.patterns(seen, pages, comps)
    assert [(p.name, p.components, p.hierarchy) for p in pats.collect()] == [("Gallery", ["button"], "section")]
    rows = sorted(detectors.evidence(comps, toks, pats).collect(), key=lambda r: r.id)
    main, api = at + "/components/button/", at + "/components/button/api"
    b, rule = "Button", "Use a link instead"
    want = [
        (main, f"{b} > description", "A button starts an action.", "documentation", b, "description", "html", 0.6, "FOUND"),
        (main, f"{b} > when_to_use", "To start an action on the page.", "usage_guideline", b, "when_to_use", "html", 0.6, "FOUND"),
        (main, f"{b} > restriction[0]", "Never nest two buttons here", "restriction", b, "restrictions", "html", 0.6, "FOUND"),
        (main, f"{b} > disambiguation[0]", rule, "restriction", b, "disambiguation_rules", "html", 0.5, "FOUND"),
        (api, f"{b} > props > variant", '{"type":"\'ghost\' | \'solid\'","default":null}', "prop", b, "props", "html", 0.7, "FOUND"),
        (api, f"{b} > props > size", '{"type":"string","default":null}', "prop", b, "props", "html", 0.7, "FOUND"),
        (main, f"{b} > variants", "Primary, ghost, solid", "documentation", b, "variants", "html", 0.6, "FOUND"),
        (main, f"{b} > states", "hover, focus", "documentation", b, "states", "html", 0.6, "FOUND"),
        (main, f"{b} > example[0]", None, "code_example", b, "examples", "html", 0.8, "FOUND"),
        (at + "/components/card", None, None, "documentation", "card", None, "html", 0.4, "NOT_EVALUABLE"),
        (at + "/tokens.json", "color.bg", '{"value":"#fff","description":"page"}', "token", None, "color.bg", "json", 1.0, "FOUND"),
        (at + "/tokens.json", "gap", '{"value":"4px","description":null}', "token", None, "gap", "json", 0.8, "FOUND"),
        (at + "/foundations/color", "color.fg", '{"value":"var(--x)","description":"text"}', "token", None, "color.fg", "html", 0.6, "FOUND"),
        (at + "/patterns/gallery", "Gallery", "button", "pattern", None, "pattern", "html", 0.6, "FOUND"),
    ]
    assert [(r.source, r.location, r.content, r.type, r.component, r.section, r.retrieval_method, r.confidence, r.status) for r in rows] == want
    assert [r.id for r in rows] == [f"ev-{k:04d}" for k in range(1, len(want) + 1)]


def test_limited_sites(spark):
    pages = spark.createDataFrame([(s, f"https://{s}.com/", "text/html", page("<h1>Hi</h1>"), False) for s in "ab"], "site_id string, url string, content_type string, body string, rendered boolean")
    records = pages.select("site_id", "url", F.lit("CRAWLED").alias("status"))
    files = spark.createDataFrame([], "id long, site_id string, body string")
    limits = spark.createDataFrame([("a", False), ("a", True), ("c", True)], "site_id string, crawl_limited boolean")
    status = scoring.coverage_status(detectors.sites(pages, records, files, limits=limits))
    assert {r.site_id: r.status for r in status.collect()} == {"a": "LIMITED", "b": "COMPLETE"}
