"""The score of a site from its normalised document: six dimensions, their sub-criteria, the gate and the level.

sites has one nested row a site (see SITE). ``sub_criteria`` makes one long table of
(site_id, dimension, criterion, points, max, applicable) with expressions over the
row's own arrays, so nothing is shuffled for it; one finaliser serves all dimensions.
Points are null where something could not be looked at, and 0 where it is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import numbers

SITE = (
    "site_id string, access struct<documentation_recoverability:string,component_index:string,props_types_accessibility:string,structured_tokens:string,"
    "types_or_schema:string,agent_manifest:string,agent_interface:string>, "
    "components array<struct<name:string,description:string,evaluation_status:string,props:array<struct<name:string,type:string,description:string,"
    "allowed_values:array<string>,default:string>>,variants:array<string>,states:array<struct<name:string,status:string>>,usage:struct<purpose:string,"
    "when_to_use:string,when_not_to_use:string,competing_components:array<string>,disambiguation_rules:array<string>,restrictions:array<string>>,"
    "composition:array<string>,accessibility:string,code_examples_count:long,executable_examples_count:long,evidence_ids:array<string>>>, "
    "tokens array<struct<name:string,type:string,category:string,alias_of:string,mode:string,intent:string,origin:string,value:string>>, "
    "patterns array<struct<name:string,components:array<string>,nesting_rules:string,hierarchy:string,layout:string,spacing:string>>, "
    "documentation struct<components_documented:long,components_with_code_examples:long,components_with_executable_examples:long,"
    "components_with_variants_states_explained:long,versioning_present:boolean>, "
    "contradictions array<struct<component:string,field:string,sources:array<string>,evidence_ids:array<string>,values:string>>, "
    "coverage struct<components_detected:long,components_evaluated:long,crawl_limited:boolean>, tokens_status string, "
    "criteria map<string,struct<status:string,reason:string>>"
)
# Fixed values of the rules.
GATE, CAP, LEAST_SHARE = 25.0, 40.0, 0.5
_SEVERITY = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}


def _some(x: Column) -> Column:
    """Neither null nor an empty string or list."""
    return F.coalesce(x.isNotNull() & (x != ""), F.lit(False))


def _any(a: Column) -> Column:
    return F.coalesce(F.size(a) > 0, F.lit(False))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array())


def _count(a: Column, test) -> Column:
    return F.size(F.filter(a, test))


def _share(a: Column, test) -> Column:
    return numbers.ratio(_count(a, test), F.size(a))


def evaluable(components: Column) -> Column:
    return F.filter(components, lambda c: F.coalesce(c["evaluation_status"], F.lit("FOUND")) != "NOT_EVALUABLE")


def _props(components: Column) -> Column:
    return F.flatten(F.transform(components, lambda c: F.coalesce(c["props"], F.array())))


def repetition(names: Column) -> Column:
    """The share of uses whose name occurs more than once; null for no names. Sorted names are gone through once."""

    def alone(s: Column) -> Column:
        return ((s["run"] == 1) & s["name"].isNotNull()).cast("int")

    def step(s: Column, name: Column) -> Column:
        same = (s["run"] > 0) & s["name"].eqNullSafe(name)
        return F.struct(name.alias("name"), F.when(same, s["run"] + 1).otherwise(1).alias("run"), (s["once"] + F.when(same, 0).otherwise(alone(s))).alias("once"))

    start = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("run"), F.lit(0).alias("once"))
    once = F.aggregate(F.array_sort(names), start, step, lambda s: s["once"] + alone(s))
    return numbers.ratio(F.size(names) - once, F.size(names))


def repetition_of(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, consistency): ``repetition`` of names that are rows, by the counts of each name, so that a group of any size isn't one row."""
    each = rows.groupBy(*keys, name).agg(F.count("*").alias("_n"))
    return each.groupBy(*keys).agg(numbers.ratio(F.sum(F.when((F.col("_n") > 1) | F.col(name).isNull(), F.col("_n")).otherwise(0)), F.sum("_n")).alias("consistency"))


def criteria_of(dimension: str) -> list[tuple[str, Column, float, Column]]:
    """(criterion, points, max, applicable) of a dimension, over columns c (evaluable components), p (their props) and the site's own."""
    yes, c, p, t, pat = F.lit(True), F.col("c"), F.col("p"), F.col("t"), F.col("pat")
    none = F.size(c) == 0

    def row(name: str, share: Column, most: float, applicable: Column = yes) -> tuple[str, Column, float, Column]:
        return name, share * most, most, applicable

    if dimension == "D1":
        return [(k, numbers.band_points(F.col("access")[k], table), most, yes) for k, (most, table) in numbers.ACCESS_POINTS.items()]
    if dimension == "D2":
        dotted = _share(t, lambda x: F.contains(x["name"], F.lit(".")))
        primitive = F.exists(t, lambda x: F.coalesce(x["category"], F.lit("")) == "primitive")
        semantic = F.exists(t, lambda x: F.coalesce(x["category"], F.lit("")) == "semantic")
        aliased = F.exists(t, lambda x: (F.coalesce(x["category"], F.lit("")) == "semantic") & _some(x["alias_of"]))

        def kinds(*names: str) -> Column:
            return F.exists(t, lambda x: F.coalesce(x["type"], F.lit("")).isin(*names)).cast("double")

        rows = [
            row("tokens_identifiable", _any(t).cast("double"), 10.0),
            row("structured_format", F.exists(t, lambda x: F.coalesce(x["origin"], F.lit("")) != "html_table").cast("double"), 15.0),
            ("naming_consistency", F.when((F.size(t) < 2) | (dotted > 0.8) | (dotted < 0.2), 15.0).otherwise(7.5), 15.0, yes),
            ("primitive_to_semantic", F.when(primitive & aliased, 20.0).when(semantic, 10.0).otherwise(0.0), 20.0, yes),
            row("color_coverage", kinds("color"), 10.0), row("spacing_sizing_coverage", kinds("spacing", "sizing"), 10.0), row("typography", kinds("typography"), 5.0),
            row("other_foundations", kinds("radius", "shadow", "border", "motion", "opacity", "z-index"), 5.0),
            row("modes", F.exists(t, lambda x: _some(x["mode"])).cast("double"), 5.0), row("intent_documentation", _share(t, lambda x: _some(x["intent"])), 5.0),
        ]
        status = F.coalesce(F.col("tokens_status"), F.when(F.size(t) == 0, "NOT_FOUND").otherwise("FOUND"))
        return [(n, F.when(status == "NOT_EVALUABLE", None).when(status == "NOT_FOUND", 0.0).otherwise(x), m, a) for n, x, m, a in rows]
    if dimension == "D3":
        states = F.flatten(F.transform(c, lambda x: F.coalesce(x["states"], F.array())))
        looked = F.filter(states, lambda s: s["status"].isin("FOUND", "NOT_FOUND"))
        rows = [
            ("props_documented", numbers.as_of_band(_share(c, lambda x: _any(x["props"])), numbers.PROPS_BANDS), 20.0, yes),
            row("types", _share(p, lambda x: _some(x["type"])), 15.0), row("allowed_values", _share(p, lambda x: _any(x["allowed_values"])), 15.0),
            row("defaults", _share(p, lambda x: x["default"].isNotNull()), 10.0), row("variants", _share(c, lambda x: _any(x["variants"])), 10.0),
            row("states", _share(looked, lambda s: s["status"] == "FOUND"), 10.0), row("api_consistency", repetition(F.transform(p, lambda x: x["name"])), 10.0),
            row("prop_purpose", _share(p, lambda x: _some(x["description"])), 10.0),
        ]
    elif dimension == "D4":
        competing = F.filter(c, lambda x: _any(x["usage"]["competing_components"]))
        rows = [
            row("purpose_identification", _share(c, lambda x: _some(x["usage"]["purpose"])), 15.0), row("component_selection", _share(c, lambda x: _some(x["usage"]["when_to_use"])), 25.0),
            row("disambiguation", _share(competing, lambda x: _any(x["usage"]["disambiguation_rules"])), 20.0, F.size(competing) > 0),
            row("restrictions", _share(c, lambda x: _any(x["usage"]["restrictions"])), 20.0), row("justification", _share(c, lambda x: _some(x["usage"]["when_not_to_use"])), 20.0),
        ]
    elif dimension == "D5":
        found = _any(pat).cast("double")
        rows = [
            row("reuse_of_existing_components", found, 20.0), row("composition_rules", _share(c, lambda x: _any(x["composition"])), 25.0),
            row("hierarchy_nesting", F.coalesce(_share(pat, lambda x: _some(x["nesting_rules"]) | _some(x["hierarchy"])), F.lit(0.0)), 20.0),
            row("documented_patterns", found, 20.0), row("layout_spacing", F.coalesce(_share(pat, lambda x: _some(x["layout"]) | _some(x["spacing"])), F.lit(0.0)), 15.0),
        ]
    else:
        d, n = F.col("documentation"), F.size(c)

        def part(field: str) -> Column:
            return numbers.ratio(F.coalesce(d[field], F.lit(0)), n)

        rows = [
            ("component_coverage", numbers.as_of_band(part("components_documented"), numbers.COMPONENT_BANDS), 30.0, yes),
            ("code_examples", numbers.as_of_band(part("components_with_code_examples"), numbers.CODE_BANDS), 20.0, yes),
            ("executable_examples", numbers.as_of_band(part("components_with_executable_examples"), numbers.LIVE_BANDS), 15.0, yes),
            row("variants_states_explained", part("components_with_variants_states_explained"), 15.0), row("accessibility", _share(c, lambda x: _some(x["accessibility"])), 10.0),
            row("versioning", F.coalesce(d["versioning_present"], F.lit(False)).cast("double"), 10.0),
        ]
    # Without an evaluable component nothing of these four dimensions can be looked at.
    return [(name, F.when(none, None).otherwise(points), most, applicable) for name, points, most, applicable in rows]


def sub_criteria(sites: DataFrame) -> DataFrame:
    """(site_id, dimension, criterion, points, max, applicable, status, reason, ord)"""
    view = sites.withColumn("c", evaluable(_list("components"))).withColumn("t", _list("tokens")).withColumn("pat", _list("patterns"))
    view = view.withColumn("p", _props(F.col("c")))
    rows = []
    for dimension in numbers.WEIGHTS:
        for name, points, most, applicable in criteria_of(dimension):
            n = len(rows)
            rows.append(F.struct(F.lit(dimension).alias("dimension"), F.lit(name).alias("criterion"), points.cast("double").alias("points"), F.lit(most).alias("max"), applicable.alias("applicable"), F.lit(n).alias("ord")))
    long = view.select("site_id", "criteria", F.explode(F.array(*rows)).alias("r")).select("site_id", "criteria", "r.*")
    return with_status(long.withColumn("over", F.try_element_at(F.coalesce("criteria", F.create_map().cast("map<string,struct<status:string,reason:string>>")), F.concat("dimension", F.lit("."), "criterion"))))


def with_status(rows: DataFrame) -> DataFrame:
    """Settles points and status of sub-criteria from their points and the override (over)."""
    o, p = F.col("over.status"), F.col("points")
    status = (
        F.when(o == "OUT_OF_SCOPE", "OUT_OF_SCOPE")
        .when(o == "NOT_EVALUABLE", "NOT_EVALUABLE")
        .when(p.isNull(), F.when(~F.col("applicable"), "NOT_APPLICABLE").otherwise("NOT_EVALUABLE"))
        .when(p >= F.col("max") - 1e-9, "FOUND")
        .when(p > 0, "PARTIAL")
        .otherwise(F.when(o == "ABSENT", "ABSENT").otherwise("NOT_FOUND"))
    )
    reason = F.coalesce(F.col("over.reason"), F.when(p.isNull(), F.when(~F.col("applicable"), "NOT_APPLICABLE").otherwise("NO_BASIS")))
    return rows.select("site_id", "dimension", "criterion", F.when(F.coalesce(~o.isin("OUT_OF_SCOPE", "NOT_EVALUABLE"), F.lit(True)), p).alias("points"), "max", "applicable", status.alias("status"), reason.alias("reason"), "ord")


def dimension_scores(subs: DataFrame) -> DataFrame:
    """(site_id, dimension, score, share, status, missing): points over the maxima of what has points, times 100; missing in the criteria's order."""
    inside = F.col("status") != "OUT_OF_SCOPE"
    seen = F.col("points").isNotNull()
    g = subs.groupBy("site_id", "dimension").agg(
        F.sum("points").alias("got"), F.sum(F.when(seen, F.col("max"))).alias("base"), F.sum(F.when(inside, F.col("max"))).alias("all"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("status") == "NOT_EVALUABLE", F.struct("ord", "criterion")))), lambda x: x["criterion"]).alias("missing"),
    )
    return g.select(
        "site_id", "dimension", (numbers.ratio(F.col("got"), F.col("base")) * 100).alias("score"), F.coalesce(F.col("base") / F.col("all"), F.lit(0.0)).alias("share"),
        F.when(F.col("base").isNull(), "NOT_EVALUABLE").when(F.size("missing") > 0, "PARTIAL").otherwise("EVALUATED").alias("status"), "missing",
    )


def global_scores(dimensions: DataFrame) -> DataFrame:
    """(site_id, raw, score, shown, level, gated, sufficiency, share, weight): the weighted mean over dimensions with a score; a
    first dimension under the gate caps it; no level where too little could be looked at."""
    w = numbers.band_points(F.col("dimension"), numbers.WEIGHTS)
    has = F.col("score").isNotNull()
    g = dimensions.withColumn("w", w).groupBy("site_id").agg(
        (F.sum(F.when(has, F.col("score") * F.col("w"))) / F.sum(F.when(has, F.col("w")))).alias("raw"), F.sum(F.when(has, F.col("w"))).alias("weight"),
        F.sum(F.col("w") * F.col("share")).alias("share"), F.max(F.when(F.col("dimension") == "D1", F.col("score"))).alias("d1"),
    )
    gated = F.coalesce(F.col("d1") < GATE, F.lit(False))
    low = (F.col("share") < LEAST_SHARE - 1e-9) | (F.coalesce("weight", F.lit(0.0)) < LEAST_SHARE - 1e-9)
    g = g.withColumn("sufficiency", F.when(F.col("d1").isNull(), "INSUFFICIENT_D1").when(low, "LOW_COVERAGE").otherwise("SUFFICIENT"))
    score = F.when(F.col("d1").isNull(), None).when(gated, F.least("raw", F.lit(CAP))).otherwise(F.col("raw"))
    g = g.withColumn("score", score).withColumn("shown", numbers.round5(numbers.clamp(score, 0.0, 100.0))).withColumn("gated", gated)
    level = F.when(F.col("sufficiency") == "SUFFICIENT", numbers.readiness(F.col("shown")))
    return g.select("site_id", "raw", "score", "shown", level.alias("level"), "gated", (gated & (F.col("raw") > CAP)).alias("capped"), "sufficiency", "share", "weight")


def coverage_status(sites: DataFrame) -> DataFrame:
    """(site_id, ratio, status): part of the components evaluated makes a run PARTIAL, and that before LIMITED."""
    ratio = numbers.ratio(F.col("coverage.components_evaluated"), F.col("coverage.components_detected"))
    limited = F.coalesce(F.col("coverage.crawl_limited"), F.lit(False))
    return sites.select("site_id", ratio.alias("ratio"), F.when(ratio < 1, "PARTIAL").when(limited, "LIMITED").otherwise("COMPLETE").alias("status"))


def findings(sites: DataFrame, subs: DataFrame) -> DataFrame:
    """(site_id, dimension, severity, component, status, rule, detail, evidence, ord) in order of severity within a site; evidence has the ids
    of the component's rows."""
    c = sites.select("site_id", F.posexplode_outer("components").alias("n", "x")).filter("x IS NOT NULL")
    none = F.lit(None).cast("string")

    def out(df: DataFrame, dimension, severity: str, status: str, rule: str, component, detail, n, ids=None) -> DataFrame:
        cells = {"dimension": dimension, "severity": F.lit(severity), "component": component, "status": F.lit(status), "rule": F.lit(rule), "detail": detail, "n": n}
        rests = F.coalesce(F.lit(None) if ids is None else ids, F.array()).cast("array<string>")
        return df.select("site_id", *[v.cast("int" if k == "n" else "string").alias(k) for k, v in cells.items()], rests.alias("evidence"))

    competing, rules = F.col("x.usage.competing_components"), F.col("x.usage.disambiguation_rules")
    no_tokens = subs.filter("dimension = 'D2'").groupBy("site_id").agg(F.max("points").alias("best"), F.max(F.when(F.col("criterion") == "tokens_identifiable", F.col("points"))).alias("any"))
    low = subs.filter("dimension = 'D6' AND criterion = 'component_coverage' AND points < 15")
    excluded = sites.select("site_id", F.size(_list("components")).alias("all"), F.size(evaluable(_list("components"))).alias("kept")).filter("kept < `all`")
    bad = sites.select("site_id", F.posexplode_outer("contradictions").alias("n", "x")).filter("x IS NOT NULL")
    every = [
        out(no_tokens.filter("best = 0 AND `any` = 0"), F.lit("D2"), "CRITICAL", "NOT_FOUND", "NO_TOKENS", none, none, F.lit(0)),
        out(c.filter(_any(competing) & ~_any(rules)), F.lit("D4"), "HIGH", "FOUND", "NO_SELECTION_RULE", F.col("x.name"), F.array_join(competing, ", "), F.col("n") * 2, F.col("x.evidence_ids")),
        out(c.filter(_any(F.col("x.props")) & ~_some(F.col("x.usage.purpose"))), F.lit("D4"), "MEDIUM", "NOT_FOUND", "NO_PURPOSE", F.col("x.name"), none, F.col("n") * 2 + 1, F.col("x.evidence_ids")),
        out(bad, F.when(F.startswith("x.field", F.lit("token")), "D2").otherwise("D3"), "HIGH", "FOUND", "CONTRADICTION", F.col("x.component"), F.col("x.values"), F.col("n") + 1_000_000, F.col("x.evidence_ids")),
        out(low, F.lit("D6"), "MEDIUM", "FOUND", "LOW_COVERAGE", none, none, F.lit(2_000_000)),
        *[out(excluded, F.lit(d), "LOW", "NOT_EVALUABLE", "EXCLUDED", none, F.format_string("%d of %d", F.col("all") - F.col("kept"), "all"), F.lit(3_000_000)) for d in ("D3", "D6")],
    ]
    union = every[0]
    for one in every[1:]:
        union = union.unionByName(one)
    rank = F.lit(9)
    for name, k in _SEVERITY.items():
        rank = F.when(F.col("severity") == name, k).otherwise(rank)
    return union.withColumn("ord", F.struct(rank.alias("rank"), "n", "dimension")).drop("n")


def certainty(subs: DataFrame, complete: bool = True) -> DataFrame:
    """Adds certainty, loss and place: what a sub-criterion shows, and its rank by points lost, weighted, within the site."""
    from pyspark.sql import Window

    s = F.col("status")
    sure = (
        F.when(s == "FOUND", "demonstrated").when(s == "PARTIAL", "partial").when(s == "ABSENT", "absent").when(s == "OUT_OF_SCOPE", "scope").when(s == "NOT_APPLICABLE", "na")
        .when(s == "NOT_EVALUABLE", "notEvaluated").otherwise("absent" if complete else "notDemonstrated")
    )
    base = F.sum(F.when(F.col("points").isNotNull(), F.col("max"))).over(Window.partitionBy("site_id", "dimension"))
    loss = F.coalesce((F.col("max") - F.col("points")) / base * numbers.band_points(F.col("dimension"), numbers.WEIGHTS), F.lit(0.0))
    out = subs.withColumn("certainty", sure).withColumn("loss", loss)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy(F.col("loss").desc(), "ord")))


def diagnosis(subs: DataFrame) -> DataFrame:
    """(site_id, dimension, works, gaps, excluded): criteria by what their status says, in their own order."""

    def names(test: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("ord", "criterion")))), lambda x: x["criterion"])

    s = F.col("status")
    return subs.groupBy("site_id", "dimension").agg(
        names(s == "FOUND").alias("works"), names(s.isin("PARTIAL", "NOT_FOUND", "ABSENT")).alias("gaps"), names(s.isin("NOT_EVALUABLE", "NOT_APPLICABLE", "OUT_OF_SCOPE")).alias("excluded")
    )


def report(sites: DataFrame) -> DataFrame:
    """One row a site: its global score, dimensions, findings and coverage."""
    subs = sub_criteria(sites)
    dims = dimension_scores(subs)
    found = findings(sites, subs).groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("ord", "dimension", "severity", "component", "rule", "detail", "evidence"))).alias("findings"))
    each = dims.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("dimension", "score", "share", "status", "missing"))).alias("dimensions"))
    return global_scores(dims).join(each, "site_id").join(coverage_status(sites), "site_id").join(found, "site_id", "left")
