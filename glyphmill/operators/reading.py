"""What a report lets one say: reading levels, limitations, capabilities and recommendations, as codes in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import numbers

# Fixed values.
GAPS, MAX_INFER = ("partial", "notDemonstrated", "absent"), 6
REASON_KEYS = {
    "EXTERNAL_NOT_READ": "rsExternal", "NOT_LOOKED": "rsNotLooked", "NOT_READ": "rsNotRead", "UNREADABLE": "rsUnreadable", "NO_BASIS": "rsExcluded",
    "PROBED": "rsProbed", "NO_INDEPENDENT_PAIRS": "rsNoPairs",
}


def level_rank(score: Column) -> Column:
    """0 to 3 by the rounded score; null without one."""
    return numbers.as_of_band(F.floor(score + 0.5), [(start, float(k)) for k, (start, _) in enumerate(numbers.LEVELS)]).cast("int")


def reason_key(rows: DataFrame, mode: str, complete: bool) -> DataFrame:
    """Adds why: the key of the reason that a criterion of rows (certainty, reason, dimension, criterion) shows."""
    table = F.create_map(*[F.lit(x) for pair in REASON_KEYS.items() for x in pair])
    own, c = F.try_element_at(table, F.col("reason")), F.col("certainty")
    consistency = (F.col("dimension") == "D3") & (F.col("criterion") == "api_consistency")
    why = (
        F.when(c == "notEvaluated", F.when(consistency, "noBasisApi").otherwise(F.coalesce(own, F.lit("rsExcluded")))).when(c.isin("scope", "absent"), own)
        .when(c == "notDemonstrated", F.lit("rsObservable" if mode == "live" else "rsIncomplete"))
    )
    return rows.withColumn("why", why)


def dimensions_read(sure: DataFrame, scores: DataFrame, complete: bool = False) -> DataFrame:
    """(site_id, dimension, score, rank, meaning, incomplete): full only at the top and without gaps."""
    c = F.col("certainty")
    open_ = c.isin("notDemonstrated", "notEvaluated") if complete else c.isin("notDemonstrated", "notEvaluated", "partial")
    g = sure.groupBy("site_id", "dimension").agg(F.count_if(c.isin(*GAPS)).alias("gaps"), F.bool_or(open_).alias("incomplete"))
    top = len(numbers.LEVELS) - 1
    r = level_rank(F.col("score"))
    j = scores.select("site_id", "dimension", "score").join(g, ["site_id", "dimension"], "left").withColumn("rank", r)
    meaning = F.when((F.col("rank") == top) & (F.col("gaps") == 0), "full").when(F.col("rank") == top, "high").when(F.col("rank") == top - 1, "mid").otherwise("low")
    return j.select("site_id", "dimension", "score", "rank", meaning.alias("meaning"), F.coalesce("incomplete", F.lit(False)).alias("incomplete"))


def capabilities(sure: DataFrame, read: DataFrame) -> DataFrame:
    """(site_id, can, may_infer, cannot, not_demonstrated, not_evaluated): dimensions by rank, and the criteria most worth doubting."""
    top, r, d = len(numbers.LEVELS) - 1, F.col("rank"), F.col("dimension")

    def listed(test: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(test, d)))

    low = r <= top - 2
    lists = read.groupBy("site_id").agg(
        listed(r == top).alias("can"), listed(low & ~F.col("incomplete")).alias("cannot"), listed(low & F.col("incomplete")).alias("not_demonstrated"),
        F.array_append(listed(r.isNull()), F.lit("D7")).alias("not_evaluated"),
    )
    high = read.filter(r >= top - 1).select("site_id", "dimension")
    worst = sure.filter(F.col("certainty").isin(*GAPS)).join(high, ["site_id", "dimension"], "left_semi")
    worst = worst.withColumn("n", F.row_number().over(Window.partitionBy("site_id").orderBy(F.col("loss").desc(), "ord"))).filter(F.col("n") <= MAX_INFER)
    infer = worst.groupBy("site_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "criterion"))), lambda x: x["criterion"]).alias("may_infer"))
    return lists.join(infer, "site_id", "left").withColumn("may_infer", F.coalesce("may_infer", F.array().cast("array<string>")))


def recommendations(sure: DataFrame, complete: bool = False) -> DataFrame:
    """(site_id, dimension, limits, direct, possible): what the run could not see, then gaps that are sure and those that may be, by loss."""
    c = F.col("certainty")

    def listed(test: Column) -> Column:
        key = F.struct((-F.col("loss")).alias("loss"), F.col("ord"), F.col("criterion"))
        return F.transform(F.sort_array(F.collect_list(F.when(test, key))), lambda x: x["criterion"])

    part = c == "partial"
    return sure.groupBy("site_id", "dimension").agg(
        listed((c == "notEvaluated") & (F.coalesce("why", F.lit("")) != "rsExcluded")).alias("limits"),
        listed((c == "absent") | (part if complete else F.lit(False))).alias("direct"), listed((c == "notDemonstrated") | (F.lit(False) if complete else part)).alias("possible"),
    )


def incomplete_reasons(sites: DataFrame, totals: DataFrame, sure: DataFrame, read: DataFrame) -> DataFrame:
    """(site_id, reasons): why a report isn't whole, as codes in their order. sites has coverage; totals and read come from scoring."""
    why = sure.groupBy("site_id").agg(F.collect_set("why").alias("whys"))
    unscored = read.groupBy("site_id").agg(F.sort_array(F.collect_list(F.when(F.col("score").isNull(), F.col("dimension")))).alias("none"))
    j = sites.select("site_id", "coverage").join(totals, "site_id").join(why, "site_id", "left").join(unscored, "site_id", "left")

    def has(*keys: str) -> Column:
        return F.coalesce(F.arrays_overlap("whys", F.array(*map(F.lit, keys))), F.lit(False))

    tests = [
        (F.coalesce(F.col("coverage.crawl_limited"), F.lit(False)), F.lit("LIMITED")), (F.col("capped"), F.lit("GATE")), (has("rsExternal"), F.lit("EXTERNAL")),
        (has("rsNotLooked", "rsNotRead"), F.lit("NOT_LOOKED")), (has("rsUnreadable"), F.lit("UNREADABLE")),
        (F.col("sufficiency") == "LOW_COVERAGE", F.concat(F.lit("LOW_COVERAGE:"), F.floor(F.col("share") * 100 + 0.5).cast("string"))),
        (F.size("none") > 0, F.concat(F.lit("NOT_EVALUATED:"), F.array_join("none", ","))),
    ]
    return j.select("site_id", F.array_compact(F.array(*[F.when(test, code) for test, code in tests])).alias("reasons"))


def limitations(sites: DataFrame, totals: DataFrame, dimensions: DataFrame, coverage: DataFrame) -> DataFrame:
    """(site_id, limitations): codes, in the order of the report."""
    d = F.when(F.col("status").isin("PARTIAL", "NOT_EVALUABLE"), F.concat_ws(":", "dimension", "status", F.array_join("missing", ",")))
    each = dimensions.groupBy("site_id").agg(F.sort_array(F.collect_list(d)).alias("dims"))
    j = sites.select("site_id", F.coalesce(F.size("contradictions"), F.lit(0)).alias("bad")).join(totals, "site_id").join(each, "site_id").join(coverage.select("site_id", F.col("status").alias("run")), "site_id")
    pct = F.floor(F.col("share") * 100 + 0.5).cast("string")
    head = F.array_compact(F.array(F.when(F.col("run").isin("PARTIAL", "LIMITED"), F.col("run"))))
    tail = F.array_compact(F.array(
        F.lit("D7:NOT_EVALUATED"), F.when(F.col("sufficiency") == "INSUFFICIENT_D1", F.lit("INSUFFICIENT_D1")),
        F.when(F.col("sufficiency") == "LOW_COVERAGE", F.concat(F.lit("LOW_COVERAGE:"), pct)), F.when(F.col("bad") > 0, F.concat(F.lit("CONTRADICTIONS:"), F.col("bad").cast("string"))),
    ))
    return j.select("site_id", F.concat(head, "dims", tail).alias("limitations"))


def texts_by(rows: DataFrame, keys: list[str], text: str, order: list[str], glue: str, name: str) -> DataFrame:
    """Texts of a group joined in order."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["_t"]), glue).alias(name))
