"""Rules of reading and scoring on small rows."""

import json
import time

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import addresses, html_scan, numbers, text, urls
from glyphmill.operators import json_tokens, relational, scoring
from glyphmill.sources import listings


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("html", "tags", "inner"),
    [("<p>uno<p>dos", "p", []), ("<p>uno</p><p>dos", "p", ["uno"]), ("<p>uno<li>dos</li>", "p|li", ["dos"]), ("<pre>x</pre>", "p", [])],
)
def test_find_blocks(html, tags, inner):
    assert [b.inner for b in html_scan.find_blocks(html, tags)] == inner


def test_strip_tags_in_both_forms(spark):
    html = "<p>Hola&nbsp;<b>mundo</b></p><script>x()</script>  fin"
    assert html_scan.strip_tags(html) == "Hola mundo fin" == one(spark, text.strip_tags(F.col("h")), h=html)


@pytest.mark.parametrize("unit", ["<p>", "<h2>", "<li>", "<a href=", "</p", "<table><tr>", "<", "<!--", "<nav>", "<script>"])
def test_hostile_pages_take_linear_time(unit):
    html = unit * (300_000 // len(unit))
    began = time.monotonic()
    html_scan.visible_text(html), html_scan.sections(html), html_scan.tables(html), html_scan.labelled_links(html)
    assert time.monotonic() - began < 15


@pytest.mark.parametrize(
    ("url", "root"),
    [("https://a.com/components/web/react/core/button/usage", "https://a.com/"), ("https://a.com/design/components/button", "https://a.com/design/"), ("https://a.com/material-ui/react-button/", "https://a.com/material-ui/")],
)
def test_ds_root(spark, url, root):
    assert one(spark, urls.ds_root(F.col("u")), u=url) == root


@pytest.mark.parametrize(
    ("path", "kind"),
    [("/patterns/forms", "pattern"), ("/patrones/", "pattern_index"), ("/foundations/color", "tokens"), ("/whats-new/changelog", "changelog"), ("/components/button", "component"), ("/components/", "other"), ("/x.png", "asset"), ("/mcp/token-use", "other")],
)
def test_classify(spark, path, kind):
    assert one(spark, urls.classify(F.col("u")), u="https://a.com" + path) == kind


def test_normalize_and_official(spark):
    assert one(spark, urls.normalize(F.col("u")), u="HTTPS://A.com/b?z=1&amp;utm_source=x&a=2#t") == "https://a.com/b?a=2&z=1"
    assert one(spark, urls.official_kind(F.col("u")), u="https://react.x.dev/?path=%2Fdocs%2Fbutton") == "storybook"
    assert one(spark, urls.official_key(F.col("u"), F.lit("repository")), u="https://github.com/o/r.git/tree") == "https://github.com/o/r"
    assert one(spark, urls.component_identity(F.col("u")), u="https://a.com/components/button/usage") == "button"


@pytest.mark.parametrize(("name", "ok"), [("$background", True), ("--color-bg", True), ("color.text.primary", True), ("colorNeutralBackground1", True), ("Rest", False), ("Gray 10", False), ("12", False)])
def test_token_names(spark, name, ok):
    assert html_scan.is_token_name(name) is ok
    assert one(spark, text.is_token_name(F.col("n")), n=name) is ok


def test_component_name(spark):
    assert one(spark, text.component_name(F.col("t"), F.lit("checkbox")), t="Checkbox Preview") == "Checkbox"
    assert one(spark, text.component_name(F.col("t"), F.lit("button")), t="Buttons") == "Buttons"
    assert one(spark, text.component_name(F.col("t"), F.lit("x")), t="") is None


def test_levels_sweep(spark):
    rows = spark.range(401).select((F.col("id") / 4).alias("x")).select("x", numbers.readiness(F.col("x")).alias("l"), numbers.round5(F.col("x")).alias("r")).collect()
    for r in rows:
        assert r.l == ("Operable" if r.x >= 75 else "Interpretable" if r.x >= 50 else "Legible" if r.x >= 25 else "Opaco")
        assert abs(r.r - r.x) <= 2.5 and r.r % 5 == 0
    assert one(spark, numbers.readiness(F.lit(float("nan"))), z=1) is None


def test_tables_states_and_facts(spark):
    html = (
        "<body><h1>Button</h1><h2>Props</h2><table><tr><th>Name</th><th>Type</th><th>Default</th></tr><tr><td>size*</td><td>'s' | 'm'</td><td>-</td></tr></table>"
        "<h2>Estados</h2><p>Foco y deshabilitado, con error.</p><h2>Tokens</h2><table><tr><th>Token</th><th>Role</th><th>Value</th></tr><tr><td>$bg</td><td>page</td><td>#fff</td></tr><tr><td>$bg</td><td>x</td><td>#000</td></tr></table>"
        "<h2>Variants</h2><ul><li>Primary: main</li><li>Ghost - light</li></ul></body>"
    )
    f = spark.createDataFrame([(html,), (None,)], "h string").select(html_scan.facts(F.col("h")).alias("f")).collect()
    assert [(p.name, p.type, p.default) for p in f[0].f.props] == [("size", "'s' | 'm'", None)]
    assert [(t.name, t.value, t.intent) for t in f[0].f.tokens] == [("$bg", "#fff", "page")]
    assert f[0].f.states == ["focus", "disabled", "error"] and f[0].f.variants == ["Primary", "Ghost"]
    assert f[0].f.outline == ["Button", "Props", "Estados", "Tokens", "Variants"] and f[1].f.props == []
    assert one(spark, text.allowed_values(F.col("t")), t="'s' | 'm'") == ["s", "m"]
    assert html_scan.tokens("<table><tr><th>Token</th></tr><tr><td>color.bg</td></tr><tr><td>a</td><td>b</td></tr></table>") == [("color.bg", "a b", None)]


def test_restrictions(spark):
    assert one(spark, text.restrictions(F.col("t")), t="Never use two. It’s fine. Don’t nest buttons here. Nunca uses tres botones.") == ["Never use two", "Don’t nest buttons here", "Nunca uses tres botones"]


def test_sources(spark):
    docs = spark.createDataFrame(
        [(1, "<urlset><url><loc>https://a.com/x?a=1&amp;b=2</loc></url><url><loc><![CDATA[https://a.com/y]]></loc></url></urlset>"), (2, "User-agent: *\r\nSitemap: https://a.com/s.xml"),
         (3, "[Docs](/docs) and https://b.com/z."), (4, json.dumps({"entries": {"a": {"title": "Core/Button"}, "b": {"title": "Core/Card"}}}))], "id long, body string",
    )
    assert {r.loc for r in listings.sitemap(docs.filter("id = 1")).collect()} == {"https://a.com/x?a=1&b=2", "https://a.com/y"}
    assert [r.sitemap for r in listings.robots(docs.filter("id = 2")).collect()] == ["https://a.com/s.xml"]
    assert "https://a.com/docs" in {r.url for r in listings.markdown_links(docs.filter("id = 3"), F.lit("https://a.com/llms.txt")).collect()}
    assert {r.name for r in listings.storybook(docs.filter("id = 4")).collect()} == {"Button", "Card"}
    assert html_scan.markdown_to_html("# A\n- b\n\n```\nx<\n```") == "<h1>A</h1>\n<ul><li>b</li></ul>\n<pre>x&lt;</pre>"
    assert html_scan.docc_to_html("{}") is None and "<h1>T</h1>" in html_scan.docc_to_html('{"metadata": {"title": "T"}}')


def test_json_tokens(spark):
    def nested(levels: int) -> str:
        return '{"k":' * levels + '{"z": 1}' + "}" * levels

    bodies = [
        '{"color": {"bg": {"$value": "#fff", "description": "page"}, "raw": 3}, "name": "x", "version": 2, "none": null, "on": true, "sub": {"name": "y"}}',
        '{"a": {"value": null, "$value": {"x": 1}, "$description": "why"}, "l": [1, "z", {"value": false}, [2.5]], "é.b": "c"}',
        nested(20), nested(21), "[1, {\"k\": 2}]", "not json", "", None, '"text"', "7", '{"a": 1, "a": 2}', "{}",
    ]
    rows = json_tokens.flatten(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"))
    got = sorted(tuple(r) for r in rows.collect())
    assert got == sorted([
        (0, "color.bg", "#fff", "page", 1.0), (0, "color.raw", "3", None, 0.8), (0, "sub.name", "y", None, 0.8),
        (1, "a", '{"x":1}', "why", 1.0), (1, "l.0", "1", None, 0.8), (1, "l.1", "z", None, 0.8), (1, "l.2", "false", None, 1.0), (1, "l.3.0", "2.5", None, 0.8), (1, "é.b", "c", None, 0.8),
        (2, ".".join(["k"] * 20 + ["z"]), "1", None, 0.8), (4, "0", "1", None, 0.8), (4, "1.k", "2", None, 0.8),
    ])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_addresses(spark):
    for ip, private in (("10.1.2.3", True), ("8.8.8.8", False), ("::1", True), ("::ffff:10.0.0.1", True), ("2606:4700::1", False), ("64:ff9b::a00:1", True), ("x", None)):
        assert one(spark, addresses.private(F.col("a")), a=ip) is private


def test_relational_order(spark):
    df = spark.createDataFrame([("a", k) for k in range(11)] + [("b", 1)], "g string, k int")
    got = sorted(r.k for r in relational.evenly_spaced(df, ["g"], ["k"], 4).filter("g = 'a'").collect())
    assert got == [int(i * (11 / 4) + 11 / 8) for i in range(4)]
    log = relational.source_log(spark.createDataFrame([("u", 1, "root", None, None), ("u", 2, "link", "READ", None), ("v", 3, "link", None, None)], "url string, ord int, role string, status string, reason string"))
    assert {(r.url, r.role, r.status) for r in log.collect()} == {("u", "root", "READ"), ("v", "link", "SKIPPED")}
    first = spark.createDataFrame([("a", None, 1)], "name string, intent string, ord int")
    second = spark.createDataFrame([("a", "why", 1), ("b", None, 2), ("b", "x", 3)], "name string, intent string, ord int")
    assert {(r.name, r.intent, r.part) for r in relational.prefer(first, second, "name", "ord").collect()} == {("a", "why", 0), ("b", "x", 1)}


def site(**over):
    component = {"name": "Button", "props": [{"name": "size", "type": "string", "description": "how big", "allowed_values": ["s"], "default": "false"}], "variants": ["primary"],
                 "states": [{"name": "hover", "status": "FOUND"}, {"name": "x", "status": "NOT_APPLICABLE"}],
                 "usage": {"purpose": "p", "when_to_use": "w", "when_not_to_use": "n", "competing_components": ["Link"], "disambiguation_rules": ["r"], "restrictions": ["r"]},
                 "composition": ["Icon"], "accessibility": "a", "evidence_ids": []}
    best = {k: max(t, key=t.get) for k, (_, t) in numbers.ACCESS_POINTS.items()}
    base = {"site_id": "s", "access": best, "components": [component], "tokens": [{"name": f"a.{k}", "type": k, "category": c, "alias_of": "x", "mode": "dark", "intent": "i", "origin": "json"} for k, c in
            (("color", "primitive"), ("spacing", "semantic"), ("typography", "semantic"), ("shadow", "semantic"))], "patterns": [{"name": "f", "hierarchy": "h", "layout": "l"}],
            "documentation": {"components_documented": 1, "components_with_code_examples": 1, "components_with_executable_examples": 1, "components_with_variants_states_explained": 1, "versioning_present": True},
            "coverage": {"components_detected": 1, "components_evaluated": 1, "crawl_limited": False}, "tokens_status": "FOUND"}
    return base | over


def scored(spark, *rows):
    df = spark.read.schema(scoring.SITE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    subs = scoring.sub_criteria(df)
    dims = scoring.dimension_scores(subs)
    return df, subs, {(r.site_id, r.dimension): r for r in dims.collect()}, {r.site_id: r for r in scoring.global_scores(dims).collect()}


def test_scores(spark):
    nothing = {k: min(t, key=t.get) for k, (_, t) in numbers.ACCESS_POINTS.items()}
    rows = [
        site(), site(site_id="gate", access=nothing), site(site_id="empty", components=[], tokens_status="NOT_EVALUABLE"),
        site(site_id="scope", criteria={"D4.disambiguation": {"status": "OUT_OF_SCOPE", "reason": "x"}, "D1.agent_manifest": {"status": "NOT_EVALUABLE", "reason": "y"}}),
        site(site_id="none", tokens=[], tokens_status="NOT_FOUND", access={k: None for k in nothing}),
    ]
    df, subs, dims, total = scored(spark, *rows)
    assert dims["s", "D1"].score == dims["s", "D2"].score == dims["s", "D4"].score == dims["s", "D5"].score == dims["s", "D6"].score == 100
    assert dims["s", "D3"].score == pytest.approx(90)  # one prop: its name is not repeated
    assert total["s"].shown == 100 and total["s"].level == "Operable" and not total["s"].gated
    assert total["gate"].gated and total["gate"].score == 40 and total["gate"].capped
    assert dims["empty", "D3"].score is None and dims["empty", "D2"].score is None and total["empty"].sufficiency == "LOW_COVERAGE" and total["empty"].level is None
    assert dims["scope", "D4"].share == 1 and dims["scope", "D1"].status == "PARTIAL" and dims["scope", "D1"].score == 100
    assert dims["none", "D2"].score == 0 and total["none"].sufficiency == "INSUFFICIENT_D1" and total["none"].score is None
    rules = {(r.site_id, r.rule) for r in scoring.findings(df, subs).collect()}
    assert ("none", "NO_TOKENS") in rules and not any(s == "s" for s, _ in rules)
    places = [r.criterion for r in scoring.certainty(subs).filter("site_id = 's'").orderBy("place").limit(1).collect()]
    assert places == ["api_consistency"]
    assert scoring.report(df).count() == 5
