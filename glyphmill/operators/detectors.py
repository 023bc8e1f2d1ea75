"""A site's normalised document from its pages: components, tokens, patterns, access, and what could not be looked at.

pages: (site_id, url, content_type, body, rendered); records: (site_id, url, status); files: (id, site_id, body) of token JSON;
declared: (site_id, method, llms_txt, has_storybook, has_code, patterns_found) a row a site. Pages are scanned once, by
``read``; everything after it is grouping of facts by site and component.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import html_scan, numbers, text, urls
from glyphmill.operators import json_tokens, relational, scoring
from glyphmill.session import cut

# Fixed values.
VARIANT_PROPS = "(?i)^(variant|kind|appearance|type|intent|tone|color|size)$"
_TYPES = dict(f.split(" ", 1) for f in ("access", "components", "tokens", "patterns") for f in [next(x for x in scoring.SITE.split(", ") if x.startswith(f + " "))])


def read(pages: DataFrame) -> DataFrame:
    """pages without bodies, and with facts f, whether they are readable, and their kind."""
    is_html = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html"))
    live, version, mcp = text.live_demos(F.col("body")).cast("long"), text.version_signal(F.col("body")), text.mcp_signal(F.col("body"))
    seen = pages.select(
        "site_id", "url", F.coalesce("rendered", F.lit(False)).alias("rendered"), is_html.alias("is_html"), html_scan.facts(F.col("body")).alias("f"),
        live.alias("live"), F.coalesce(version, F.lit(False)).alias("version"), F.coalesce(mcp, F.lit(False)).alias("mcp"),
    )
    return seen.withColumn("readable", F.col("is_html") & (F.col("f.text_chars") >= text.MIN_READABLE)).withColumn("kind", urls.classify(F.col("url")))


def _first(value: Column, order: Column, also: Column | None = None) -> Column:
    has = value.isNotNull() if also is None else value.isNotNull() & also
    return F.min_by(value, F.when(has, order))


def _all(values: Column, order: Column, of: Column) -> Column:
    """The elements of a group's arrays, in order, where of holds."""
    return F.flatten(F.transform(F.sort_array(F.collect_list(F.when(of, F.struct(order.alias("o"), values.alias("v"))))), lambda x: x["v"]))


def components(seen: DataFrame, records: DataFrame) -> DataFrame:
    """(site_id, identity, source, component, prop_sources): one for all tabs of a component, and one that can't be evaluated for each whose pages all failed.
    prop_sources has the page of each prop."""
    tabs = seen.filter(F.col("is_html") & urls.is_component_page(F.col("url"))).withColumn("identity", urls.component_identity(F.col("url")))
    last = urls.last_segment(F.col("url"))
    tabs = tabs.withColumn("order", F.struct(F.array_position(F.array(*map(F.lit, urls.TAB_ORDER)), last).alias("rank"), F.length("url").alias("n"), F.col("url")))
    o, ok = F.col("order"), F.col("readable")
    prop = F.transform("f.props", lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), p["description"].alias("description"), text.allowed_values(p["type"]).alias("allowed_values"), p["default"].alias("default"), F.col("url").alias("source")))
    accessible = F.col("f.has_accessibility") | last.isin("accessibility", "accesibilidad")
    g = tabs.groupBy("site_id", "identity").agg(
        F.min_by("url", o).alias("source"), F.min_by("f.title", o).alias("title"), F.bool_or(ok).alias("ok"), F.min_by("f.lead", o).alias("lead"),
        _first(F.col("f.when_to_use"), o, ok).alias("when_to_use"), _first(F.col("f.when_not_to_use"), o, ok).alias("when_not_to_use"),
        _all(F.col("f.restrictions"), o, ok).alias("restrictions"), _all(F.col("f.rules"), o, ok).alias("rules"), _all(prop, o, ok).alias("props"),
        _all(F.col("f.variants"), o, ok).alias("variants"), _all(F.col("f.states"), o, ok).alias("states"),
        _first(F.col("url"), o, ok & accessible).alias("accessibility"), F.sort_array(F.collect_set(F.when(ok & F.col("f.has_anatomy"), F.col("url")))).alias("composition"),
        F.sum(F.when(ok, F.col("f.code"))).alias("code"), F.sum(F.when(ok, F.col("live"))).alias("live"),
    )
    names = F.transform("props", lambda p: p["name"])
    own = F.filter("props", lambda p, k: F.array_position(names, p["name"]) == k + 1)
    listed = F.flatten(F.transform(F.filter("props", lambda p: p["name"].rlike(VARIANT_PROPS)), lambda p: p["allowed_values"]))
    none = F.array().cast("array<string>")
    plain = F.transform(own, lambda p: F.struct(*[p[k].alias(k) for k in ("name", "type", "description", "allowed_values", "default")]))
    state = F.transform(F.array_distinct("states"), lambda s: F.struct(s.alias("name"), F.lit("FOUND").alias("status")))
    absent = F.array(F.struct(F.lit("states").alias("name"), F.lit("NOT_FOUND").alias("status")))
    rules = F.array_distinct("rules")
    found = g.select(
        "site_id", "identity", "source",
        F.struct(
            F.coalesce(text.component_name(F.col("title"), F.col("identity")), urls.path_to_name(F.col("source"))).alias("name"), F.when(F.col("ok"), F.col("lead")).alias("description"),
            F.when(~F.col("ok"), "NOT_EVALUABLE").alias("evaluation_status"), plain.alias("props"), F.array_union("variants", F.coalesce(listed, none)).alias("variants"),
            F.when(~F.col("ok"), F.array()).when(F.size("states") > 0, state).otherwise(absent).alias("states"),
            F.struct(
                F.when(F.col("ok"), F.col("lead")).alias("purpose"), "when_to_use", "when_not_to_use", F.array_distinct(F.transform(rules, lambda r: r["competitor"])).alias("competing_components"),
                F.transform(rules, lambda r: r["rule"]).alias("disambiguation_rules"), F.array_distinct("restrictions").alias("restrictions"),
            ).alias("usage"),
            F.col("composition").alias("composition"), F.col("accessibility").alias("accessibility"), F.coalesce("code", F.lit(0)).alias("code_examples_count"),
            F.coalesce("live", F.lit(0)).alias("executable_examples_count"), none.alias("evidence_ids"),
        ).alias("component"),
        F.transform(own, lambda p: p["source"]).alias("prop_sources"),
    )
    lost = records.filter((F.col("status") == "FAILED") & urls.is_component_page(F.col("url"))).withColumn("identity", urls.component_identity(F.col("url")))
    lost = lost.join(g.select("site_id", "identity"), ["site_id", "identity"], "left_anti").groupBy("site_id", "identity").agg(F.min("url").alias("source"))
    kind = found.schema["component"].dataType
    blank = F.from_json(F.to_json(F.struct(F.col("identity").alias("name"), F.lit("NOT_EVALUABLE").alias("evaluation_status"))), kind)
    return found.unionByName(lost.select("site_id", "identity", "source", blank.alias("component")), allowMissingColumns=True)


def tokens(seen: DataFrame, files: DataFrame) -> DataFrame:
    """(site_id, name, value, intent, origin, source, confidence, nth): those of JSON files (id, site_id, body, and url if there is one), all of them, then
    those of tables whose names JSON lacks, once each; nth is their order."""
    at = F.col("url") if "url" in files.columns else F.lit(None).cast("string")
    leaf = json_tokens.flatten(files.select("id", "body")).join(files.select("id", "site_id", at.alias("source")), "id")
    place = lambda origin, *by: F.struct(F.lit(origin).alias("origin"), *by).alias("nth")
    structured = leaf.select("site_id", "name", "value", "intent", F.lit("json").alias("origin"), "source", "confidence", place(0, F.col("source").alias("page"), F.col("id").cast("string").alias("file"), F.lit(0).cast("long").alias("n"), F.col("name").alias("name")))
    rows = seen.select("site_id", "url", F.posexplode("f.tokens").alias("n", "t")).select("site_id", "url", F.col("n").cast("long").alias("n"), "t.*")
    extra = relational.first_per(rows.join(structured.select("site_id", "name").distinct(), ["site_id", "name"], "left_anti"), ["site_id", "name"], ["url", "n"])
    intents = rows.filter("intent IS NOT NULL").groupBy("site_id", "name").agg(F.min_by("intent", F.struct("url", "n")).alias("_intent"))
    structured = structured.join(intents, ["site_id", "name"], "left").withColumn("intent", F.coalesce("intent", "_intent")).drop("_intent")
    of_tables = extra.select("site_id", "name", "value", "intent", F.lit("html_table").alias("origin"), F.col("url").alias("source"), F.lit(0.6).alias("confidence"), place(1, F.col("url").alias("page"), F.lit("").alias("file"), "n", F.lit("").alias("name")))
    return structured.unionByName(of_tables)


def patterns(seen: DataFrame, pages: DataFrame, comps: DataFrame) -> DataFrame:
    """(site_id, url, name, components, hierarchy, layout) of pattern pages that say something. What is mentioned is sought in all of a page's text."""
    p = seen.filter((F.col("kind") == "pattern") & F.col("is_html"))
    own = pages.join(p.select("site_id", "url"), ["site_id", "url"], "left_semi").select("site_id", F.col("url").alias("id"), text.strip_tags(F.col("body")).alias("text"))
    own = own.filter(F.length("text") >= text.MIN_SHELL)
    said = relational.mentions(own, comps.select("site_id", F.col("component.name").alias("name"))).withColumnRenamed("id", "url")
    p = p.join(own.select("site_id", F.col("id").alias("url")), ["site_id", "url"], "left_semi")
    return p.join(said, ["site_id", "url"], "left").select(
        "site_id", "url", F.coalesce("f.title", "url").alias("name"), F.coalesce("names", F.array().cast("array<string>")).alias("components"),
        F.when(F.col("f.has_hierarchy") | F.col("f.has_anatomy"), "section").alias("hierarchy"), F.when(F.col("f.has_layout"), "section").alias("layout"),
    )


#: Confidence of a fact by what it rests on (fixed values). What tokens rest on comes with them.
SURE = {"documentation": 0.6, "usage_guideline": 0.6, "restriction": 0.6, "disambiguation": 0.5, "prop": 0.7, "accessibility": 0.6, "code_example": 0.8, "unread": 0.4, "pattern": 0.6}
_FACT = ("source", "location", "content", "type", "section", "status", "confidence")


def component_facts(comps: DataFrame) -> DataFrame:
    """(site_id, identity, n, component and _FACT): a row for each thing that is said of a component, in a fixed order. comps: (site_id, identity,
    source, component, prop_sources)."""
    c, none, where = F.col("component"), F.lit(None).cast("string"), F.col("source")
    use, texts = c["usage"], "array<string>"

    def fact(source: Column, place: Column, content: Column, kind: str, section: str, sure: str | None = None) -> Column:
        location = F.when(place.isNotNull(), F.concat(c["name"], F.lit(" > "), place))
        cells = (source, location, content, F.lit(kind), F.lit(section), F.lit("FOUND"), F.lit(SURE[sure or kind]))
        return F.struct(*[v.cast("double" if k == "confidence" else "string").alias(k) for k, v in zip(_FACT, cells, strict=True)])

    def if_some(value: Column, one: Column) -> Column:
        return F.filter(F.array(F.when(value.isNotNull() & (value != ""), one)), lambda x: x.isNotNull())

    def single(value: Column, place: str, kind: str) -> Column:
        return if_some(value, fact(where, F.lit(place), value, kind, place))

    def each(values: Column, place: str, section: str, sure: str | None = None) -> Column:
        return F.transform(F.coalesce(values, F.array().cast(texts)), lambda t, k: fact(where, F.format_string(f"{place}[%d]", k), t, "restriction", section, sure))

    def joined(values: Column, section: str) -> Column:
        all_ = F.array_join(values, ", ")
        return if_some(all_, fact(where, F.lit(section), all_, "documentation", section))

    def prop(p: Column, k: Column) -> Column:
        said = F.to_json(F.struct(p["type"].alias("type"), p["default"].alias("default")), {"ignoreNullFields": "false"})
        return fact(F.get(F.col("prop_sources"), k), F.concat(F.lit("props > "), p["name"]), said, "prop", "props")

    props = F.transform(F.coalesce(c["props"], F.array().cast(_PROPS)), prop)
    states = F.transform(F.filter(c["states"], lambda x: x["status"] == "FOUND"), lambda x: x["name"])
    examples = F.coalesce(c["code_examples_count"], F.lit(0))
    codes = F.when(examples > 0, F.transform(F.sequence(F.lit(0).cast("long"), examples - 1), lambda k: fact(where, F.format_string("example[%d]", k), none, "code_example", "examples")))
    facts = F.concat(
        single(c["description"], "description", "documentation"), single(use["when_to_use"], "when_to_use", "usage_guideline"), single(use["when_not_to_use"], "when_not_to_use", "usage_guideline"),
        each(use["restrictions"], "restriction", "restrictions"), each(use["disambiguation_rules"], "disambiguation", "disambiguation_rules", "disambiguation"), props,
        joined(c["variants"], "variants"), joined(states, "states"), if_some(c["accessibility"], fact(c["accessibility"], F.lit("accessibility"), none, "accessibility", "accessibility")),
        F.coalesce(codes, F.array().cast(_FACTS)),
    )
    unread = F.array(F.struct(*[v.cast("double" if k == "confidence" else "string").alias(k) for k, v in zip(_FACT, (where, none, none, F.lit("documentation"), none, F.lit("NOT_EVALUABLE"), F.lit(SURE["unread"])), strict=True)]))
    out = comps.withColumn("_facts", F.when(c["evaluation_status"] == "NOT_EVALUABLE", unread).otherwise(facts))
    return out.select("site_id", "identity", c["name"].alias("component"), F.posexplode("_facts").alias("n", "f")).select("site_id", "identity", F.col("n").cast("long").alias("n"), "component", "f.*")


_PROPS = "array<struct<name:string,type:string,description:string,allowed_values:array<string>,default:string>>"
_FACTS = "array<struct<" + ",".join(f"{k}:{'double' if k == 'confidence' else 'string'}" for k in _FACT) + ">>"


def evidence(comps: DataFrame, toks: DataFrame, pats: DataFrame) -> DataFrame:
    """(site_id, id, source, location, content, type, component, section, version, retrieval_method, confidence, status, identity): what each fact
    rests on, numbered within a site: components by identity, then tokens, then patterns."""
    none = F.lit(None).cast("string")
    order = F.struct(F.lit(None).cast("int").alias("origin"), none.alias("page"), none.alias("file"), F.lit(None).cast("long").alias("n"), none.alias("name"))
    of_comps = component_facts(comps).select("site_id", F.lit(0).alias("part"), F.col("identity").alias("key"), order.withField("n", F.col("n")).alias("nth"), *_FACT, "component", F.lit("html").alias("retrieval_method"), "identity")
    told = F.to_json(F.struct("value", F.col("intent").alias("description")), {"ignoreNullFields": "false"})
    of_toks = toks.select("site_id", F.lit(1).alias("part"), F.lit("").alias("key"), "nth", "source", F.col("name").alias("location"), told.alias("content"), F.lit("token").alias("type"), F.col("name").alias("section"),
                          F.lit("FOUND").alias("status"), "confidence", none.alias("component"), F.when(F.col("origin") == "json", "json").otherwise("html").alias("retrieval_method"), none.alias("identity"))
    of_pats = pats.select("site_id", F.lit(2).alias("part"), F.col("url").alias("key"), order.alias("nth"), F.col("url").alias("source"), F.col("name").alias("location"), F.when(F.size("components") > 0, F.array_join("components", ", ")).alias("content"),
                          F.lit("pattern").alias("type"), F.lit("pattern").alias("section"), F.lit("FOUND").alias("status"), F.lit(SURE["pattern"]).alias("confidence"), none.alias("component"), F.lit("html").alias("retrieval_method"), none.alias("identity"))
    out = relational.numbered_ids(of_comps.unionByName(of_toks).unionByName(of_pats), ["site_id"], ["part", "key", "nth"])
    return out.select("site_id", "id", "source", "location", "content", "type", "component", "section", none.alias("version"), "retrieval_method", "confidence", "status", "identity")


def listing_facts(records: DataFrame) -> DataFrame:
    """(site_id, manifests, schemas, has_index, has_types, has_token_file, changelog): what the addresses that were read say."""
    u = F.lower("url")
    agent, schema = u.rlike(r"(agents\.md|llms\.txt)$"), u.rlike(r"\.d\.ts$|schema[^/]*\.json$")
    return records.filter("status = 'CRAWLED'").groupBy("site_id").agg(
        F.sort_array(F.collect_set(F.when(agent, F.col("url")))).alias("manifests"), F.sort_array(F.collect_set(F.when(schema, F.col("url")))).alias("schemas"),
        F.bool_or(u.rlike(r"(index|stories)\.json$")).alias("has_index"), F.bool_or(u.rlike(r"\.d\.ts$")).alias("has_types"),
        F.bool_or(F.contains(u, F.lit("token")) & u.rlike(r"\.json$")).alias("has_token_file"), F.bool_or(urls.classify(F.col("url")) == "changelog").alias("changelog"),
        F.bool_or(u.rlike("(^|[/.-])mcp([/.-]|$)")).alias("mcp_path"),
    )


def probe(answers: DataFrame) -> DataFrame:
    """(site_id, llms_txt) from answers (site_id, http_status, content_type, body) at the standard addresses: a page that answers with HTML is no file."""
    body = F.coalesce("body", F.lit(""))
    soft = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html")) | body.rlike(r"^\s*<") | (F.trim(body) == "")
    real = (F.col("http_status") == 200) & ~soft
    missing = F.col("http_status").isin(404, 410) | ((F.col("http_status") == 200) & soft)
    return answers.groupBy("site_id").agg(F.when(F.bool_or(real), "FOUND").when(F.bool_and(missing), "ABSENT").otherwise("UNKNOWN").alias("llms_txt"))


def tokens_status(seen: DataFrame, records: DataFrame, found: DataFrame) -> DataFrame:
    """(site_id, tokens_status): none found is only said where token places were read, all of them."""

    def place(u: Column) -> Column:
        return (urls.classify(u) == "tokens") | F.coalesce(urls.is_design_token(u), F.lit(False))

    full = ~F.col("is_html") | F.col("readable")
    read_ = seen.filter(place(F.col("url"))).groupBy("site_id").agg(F.bool_or(full).alias("read"), F.bool_or(~full).alias("empty"))
    failed = records.groupBy("site_id").agg(F.bool_or((F.col("status") == "FAILED") & place(F.col("url"))).alias("failed"))
    any_ = found.select("site_id").distinct().withColumn("any", F.lit(True))
    j = failed.join(read_, "site_id", "left").join(any_, "site_id", "left")
    clear = F.coalesce(F.col("read") & ~F.col("empty") & ~F.col("failed"), F.lit(False))
    return j.select("site_id", F.when(F.col("any"), "FOUND").when(clear, "NOT_FOUND").otherwise("NOT_EVALUABLE").alias("tokens_status"))


def criteria(sites: DataFrame) -> DataFrame:
    """sites with criteria: the sub-criteria that could not be looked at, or are surely absent, each with its reason."""
    a, t = F.col("access"), F.col("tokens")
    book, code = (F.coalesce(c, F.lit(False)) for c in ("has_storybook", "has_code"))
    kept = scoring.evaluable(F.col("components"))
    no_props = (F.size(kept) > 0) & ~F.exists(kept, lambda c: F.coalesce(F.size(c["props"]) > 0, F.lit(False)))
    no_live = (F.size(kept) > 0) & ~F.exists(kept, lambda c: F.coalesce(c["executable_examples_count"], F.lit(0)) > 0)
    flat = (F.size(t) > 0) & F.forall(t, lambda x: x["origin"] == "html_table")
    known = F.coalesce(F.col("method").isin("llms.txt", "sitemap", "navigation"), F.lit(False))
    several = F.coalesce("patterns_found", F.lit(0)) > 0
    unread = F.when(F.col("pattern_pages_read") | (known & ~several), None).when(several, "NOT_READ").otherwise("NOT_LOOKED")
    no_pattern = F.when(F.size("patterns") == 0, unread)
    out, absent, external = "NOT_EVALUABLE", "ABSENT", F.lit("EXTERNAL_NOT_READ")
    rules = [
        ("D1.agent_manifest", (a["agent_manifest"] == "NONE") & (F.col("llms_txt") == "ABSENT"), absent, F.lit("PROBED")),
        ("D1.component_index", (a["component_index"] == "NONE") & book, out, external),
        ("D1.types_or_schema", (a["types_or_schema"] == "NONE") & code, out, external),
        ("D1.props_types_accessibility", (a["props_types_accessibility"] == "NAMES_ONLY") & (book | code), out, external),
        ("D1.structured_tokens", (a["structured_tokens"] == "NOT_RECOVERABLE") & (F.col("tokens_status") == out), out, F.when(code, external).otherwise("NOT_LOOKED")),
        ("D2.primitive_to_semantic", flat & ~F.exists(t, lambda x: x["alias_of"].isNotNull()), out, F.lit("UNREADABLE")),
        ("D2.modes", flat & ~F.exists(t, lambda x: x["mode"].isNotNull()), out, F.lit("UNREADABLE")),
        ("D3.props_documented", no_props & (book | code), out, external),
        *[(f"D5.{k}", no_pattern.isNotNull(), out, no_pattern) for k in ("reuse_of_existing_components", "hierarchy_nesting", "documented_patterns", "layout_spacing")],
        ("D4.disambiguation", F.lit(True), "OUT_OF_SCOPE", F.lit("NO_INDEPENDENT_PAIRS")),
        ("D6.executable_examples", no_live & book, out, external),
    ]
    entries = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(k), F.struct(F.lit(status).alias("status"), reason.alias("reason")))) for k, test, status, reason in rules]
    return sites.withColumn("criteria", F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def sites(pages: DataFrame, records: DataFrame, files: DataFrame, declared: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """One row a site that scoring.report takes; limits (site_id, crawl_limited) as ``frontier.limits_reached`` finds them. Bodies are left behind after one scan; the rest is joined by site."""
    seen = cut(read(pages))
    comps, toks = cut(components(seen, records)), cut(tokens(seen, files))
    pats = patterns(seen, pages, comps)
    utility = urls.is_utility(F.col("url"))
    tried = records.groupBy("site_id").agg(
        F.count("*").alias("found"), F.count_if(F.col("status") == "CRAWLED").alias("retrieved"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status").isin("CRAWLED", "FAILED") & ~utility).alias("attempted"),
    )
    read_ = seen.groupBy("site_id").agg(
        F.count_if(F.col("readable") & ~F.col("rendered") & ~utility).alias("readable"), F.bool_or(F.startswith("kind", F.lit("pattern"))).alias("pattern_pages_read"),
        F.bool_or("version").alias("version"), F.bool_or("mcp").alias("mcp"),
    )
    own = evidence(comps, toks, pats).filter("identity IS NOT NULL").groupBy("site_id", "identity").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    comps = comps.join(own, ["site_id", "identity"], "left").withColumn("component", F.col("component").withField("evidence_ids", F.coalesce("ids", F.array().cast("array<string>"))))
    by_comp = comps.groupBy("site_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("identity", "component"))), lambda x: x["component"]).alias("components"))
    token = F.struct(
        F.col("name"), text.guess_type(F.col("name")).alias("type"), F.coalesce(text.token_category(F.col("value"), F.col("name")), F.lit("primitive")).alias("category"),
        F.when(text.token_category(F.col("value"), F.lit("a")).isNotNull(), F.col("value")).alias("alias_of"), F.lit(None).cast("string").alias("mode"), "intent", "origin", "value",
    )
    by_token = toks.groupBy("site_id").agg(F.sort_array(F.collect_list(token)).alias("tokens"))
    pattern = F.struct("name", "components", F.lit(None).cast("string").alias("nesting_rules"), "hierarchy", "layout", F.lit(None).cast("string").alias("spacing"))
    by_pattern = pats.groupBy("site_id").agg(F.sort_array(F.collect_list(pattern)).alias("patterns"))
    if declared is None:
        declared = records.sparkSession.createDataFrame([], "site_id string, method string, llms_txt string, has_storybook boolean, has_code boolean, patterns_found long")
    if limits is None:
        limits = records.sparkSession.createDataFrame([], "site_id string, crawl_limited boolean")
    limits = limits.groupBy("site_id").agg(F.bool_or("crawl_limited").alias("crawl_limited"))
    parts = [limits, read_, by_comp, by_token, by_pattern, listing_facts(records), tokens_status(seen, records, toks), declared]
    j = reduce(lambda x, y: x.join(y, "site_id", "left"), parts, tried)
    for name in ("components", "tokens", "patterns"):
        j = j.withColumn(name, F.coalesce(F.col(name), F.array()).cast(_TYPES[name]))

    def flag(name: str, yes: str, no: str) -> Column:
        return F.when(F.col(name), yes).otherwise(no)

    kept = scoring.evaluable(F.col("components"))
    typed = numbers.ratio(F.size(F.filter(kept, lambda c: F.exists(F.coalesce(c["props"], F.array()), lambda p: p["type"].isNotNull()))), F.size(kept)) >= 0.5
    access = F.struct(
        numbers.recoverability(numbers.ratio(F.coalesce("readable", F.lit(0)), F.col("attempted"))).alias("documentation_recoverability"), flag("has_index", "COMPLETE", "NONE").alias("component_index"),
        F.when(F.col("has_types"), "PROPS_AND_TYPES").when(typed, "PARTIAL").otherwise("NAMES_ONLY").alias("props_types_accessibility"),
        F.when(F.col("has_token_file"), "COMPLETE").when(F.exists("tokens", lambda t: t["origin"] == "html_table"), "PARTIAL").otherwise("NOT_RECOVERABLE").alias("structured_tokens"),
        flag("has_types", "COMPLETE", "NONE").alias("types_or_schema"), F.when(F.size("manifests") > 0, "COMPLETE").otherwise("NONE").alias("agent_manifest"),
        F.when(F.coalesce("mcp", F.lit(False)) | F.coalesce("mcp_path", F.lit(False)), "PRESENT").otherwise("NONE").alias("agent_interface"),
    )

    def counted(test) -> Column:
        return F.size(F.filter("components", test)).cast("long")

    docs = F.struct(
        counted(lambda c: c["description"].isNotNull()).alias("components_documented"), counted(lambda c: c["code_examples_count"] > 0).alias("components_with_code_examples"),
        counted(lambda c: c["executable_examples_count"] > 0).alias("components_with_executable_examples"),
        counted(lambda c: (F.size(c["variants"]) > 0) | F.exists(c["states"], lambda s: s["status"] == "FOUND")).alias("components_with_variants_states_explained"),
        (F.coalesce("changelog", F.lit(False)) | F.coalesce("version", F.lit(False))).alias("versioning_present"),
    )
    n = F.size("components").cast("long")
    cover = F.struct(n.alias("components_detected"), n.alias("components_evaluated"), F.coalesce("crawl_limited", F.lit(False)).alias("crawl_limited"), F.col("found").alias("pages_found"), F.col("retrieved").alias("pages_retrieved"), F.col("failed").alias("pages_failed"))
    j = j.withColumn("access", access).withColumn("documentation", docs).withColumn("coverage", cover).withColumn("pattern_pages_read", F.coalesce("pattern_pages_read", F.lit(False)))
    bad = F.array().cast("array<struct<component:string,field:string,sources:array<string>,evidence_ids:array<string>,values:string>>")
    j = criteria(j).withColumn("contradictions", bad)
    return j.select("site_id", "access", "components", "tokens", "patterns", "documentation", "contradictions", "coverage", "tokens_status", "criteria", "manifests", "schemas")
