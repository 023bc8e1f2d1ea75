"""Order-sensitive relational operators. Order is always an explicit column list; none of these collects rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Distinct by keys, keeping the first row in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """At most k rows a group, in order. Spark keeps k rows a group before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


RANGES = 256


def _range_of(df: DataFrame, by: str | Column, ranges: int) -> Column:
    """Which of some ranges, cut at quantiles, a number or time is in, ascending; null is -1, and other types have one range."""
    column = F.col(by) if isinstance(by, str) else by
    kind = df.select(column.alias("x")).schema["x"].dataType
    if isinstance(kind, (TimestampType, DateType)):
        value = F.unix_micros(column.cast("timestamp")).cast("double")
    elif isinstance(kind, NumericType):
        value = column.cast("double")
    else:
        return F.lit(0)
    cuts = sorted(set(df.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("c")).first()["c"] or []))
    ends = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]).cast("array<int>")
    further = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(ends, at + step - 1) <= value), at + step).otherwise(at)
    return F.when(value.isNull(), -1).otherwise(F.aggregate(steps, F.lit(0), further))


def in_ranges(df: DataFrame, keys: list[str], order: list, amount: str | None = None, ranges: int = RANGES) -> DataFrame:
    """Adds _sofar, the sum of amount (or the number of rows) of a group up to a row in order, itself included, and _size, the group's
    rows. Only rows of one group and one range of the first order column are sorted together, and the sums of ranges give the
    rest, so a group of any size isn't one task."""
    dealt = df.withColumn("_range", _range_of(df, order[0], ranges))
    value = F.col(amount) if amount else F.lit(1)
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(value).alias("_s"), F.count("*").alias("_c"))
    group = Window.partitionBy(*keys)
    before = sums.select(
        *[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)], F.col("_range").alias("_at"),
        (F.sum("_s").over(group.orderBy("_range")) - F.col("_s")).alias("_before"), F.sum("_c").over(group).alias("_size"),
    )
    own = F.sum(value).over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_range") == F.col("_at")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{n}"))
    out = dealt.withColumn("_own", own).join(before, same).withColumn("_sofar", F.col("_before") + F.col("_own"))
    return out.drop("_range", "_at", "_before", "_own", *[f"_key{n}" for n in range(len(keys))])


def evenly_spaced(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """n of the m rows of each group at even steps: those at floor(i m/n + m/2n); all of them if m <= n."""
    # The i whose step could end here; the division is done as the rule does it.
    at, m = F.col("_sofar") - 1, F.col("_size")
    i = F.floor((at + 1) * n / m)

    def hits(k: Column) -> Column:
        return F.floor(k * (m / n) + m / n / 2) == at

    near = F.exists(F.array(i - 2, i - 1, i, i + 1), lambda k: (k >= 0) & (k < n) & hits(k))
    return in_ranges(df, keys, order).filter((m <= n) | near).drop("_sofar", "_size")


def capped(df: DataFrame, group: str, order: list, cap: int, exempt: list[str]) -> DataFrame:
    """Adds listed (the first cap rows of a group, and all of exempt groups) and truncated (how many of the group aren't)."""
    free = F.col(group).isin(exempt)
    left = F.when(free, 0).otherwise(F.greatest(F.col("_size") - cap, F.lit(0))).cast("long")
    return in_ranges(df, [group], order).withColumn("listed", free | (F.col("_sofar") <= cap)).withColumn("truncated", left).drop("_sofar", "_size")


def numbered_ids(df: DataFrame, keys: list[str], order: list, prefix: str = "ev-", width: int = 4) -> DataFrame:
    """Ids that count rows of a group in order; longer numbers aren't cut."""
    n = F.col("_sofar").cast("string")
    return in_ranges(df, keys, order).withColumn("id", F.concat(F.lit(prefix), F.lpad(n, F.greatest(F.lit(width), F.length(n)), F.lit("0")))).drop("_sofar", "_size")


def coalesce_first(df: DataFrame, keys: list[str], value: Column, order: Column, name: str) -> DataFrame:
    """Per group the value at the smallest order where it is neither null nor empty."""
    return df.groupBy(*keys).agg(F.min_by(value, F.when(value.isNotNull() & (value != ""), order)).alias(name))


def ordered_union(df: DataFrame, keys: list[str], values: str, order: str, name: str) -> DataFrame:
    """The distinct elements of a group's arrays, in the order first seen."""
    lists = F.transform(F.sort_array(F.collect_list(F.struct(order, values))), lambda x: x[values])
    return df.groupBy(*keys).agg(F.array_distinct(F.flatten(lists)).alias(name))


def left_over(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti")


def probed(df: DataFrame, table: DataFrame, probes: list[str], key: str, value: str) -> DataFrame:
    """A left lookup by several columns: the value of the first probe that the table has. table has one row a key."""
    out = df
    for n, probe in enumerate(probes):
        side = table.select(F.col(key).alias(f"_k{n}"), F.col(value).alias(f"_v{n}"))
        out = out.join(side, out[probe] == side[f"_k{n}"], "left").drop(f"_k{n}")
    return out.withColumn(value, F.coalesce(*[F.col(f"_v{n}") for n in range(len(probes))])).drop(*[f"_v{n}" for n in range(len(probes))])


def usage_of(sources: DataFrame, used: DataFrame) -> DataFrame:
    """sources (url, final_url) with used_as: the sorted distinct uses that used (url, use) has under either address."""
    either = sources.select("url", F.explode(F.array_distinct(F.array("url", F.coalesce("final_url", "url")))).alias("at"))
    found = either.join(used.withColumnRenamed("url", "at"), "at").groupBy("url").agg(F.sort_array(F.collect_set("use")).alias("used_as"))
    return sources.join(found, "url", "left").withColumn("used_as", F.coalesce("used_as", F.array().cast("array<string>")))


def first_evidence(rows: DataFrame, ids: str, evidence: DataFrame, name: str = "source") -> DataFrame:
    """rows with the first source that is not null among the evidence (id, source) of their list of ids. rows need a unique column id."""
    each = rows.select("id", F.posexplode(ids).alias("_n", "_e")).join(evidence.select(F.col("id").alias("_e"), "source"), "_e")
    first = each.filter("source IS NOT NULL").groupBy("id").agg(F.min_by("source", "_n").alias(name))
    return rows.join(first, "id", "left")


def tokens_per_source(tokens: DataFrame) -> DataFrame:
    """(source, tokens): how many tokens have each source, as first_evidence found it."""
    return tokens.filter("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("tokens"))


def unused_names(sources: DataFrame, names: DataFrame) -> DataFrame:
    """sources (identity, used_as, ...) with tab_of: the name (identity, name) that a page of a component belongs to, where nothing of it was used."""
    one = names.groupBy("identity").agg(F.min("name").alias("_name"))
    out = sources.join(one, "identity", "left")
    return out.withColumn("tab_of", F.when(F.size("used_as") == 0, F.col("_name"))).drop("_name")


def prefer(first: DataFrame, second: DataFrame, name: str, order: str) -> DataFrame:
    """All rows of first, and of second those whose name first lacks, each name once; a null intent of first's rows
    takes that of second's row of the same name."""
    extra = first_per(second.join(first.select(name).distinct(), name, "left_anti"), [name], [order])
    intents = second.filter("intent IS NOT NULL").groupBy(name).agg(F.min_by("intent", order).alias("_intent"))
    both = first.withColumn("part", F.lit(0)).unionByName(extra.withColumn("part", F.lit(1)))
    return both.join(intents, name, "left").withColumn("intent", F.coalesce("intent", "_intent")).drop("_intent")


def source_log(events: DataFrame) -> DataFrame:
    """events (url, ord, role, status, reason): the first sets the role, the last status counts, and what is left pending was
    skipped."""
    last = F.max_by(F.struct("status", "reason"), F.when(F.col("status").isNotNull(), F.col("ord")))
    log = events.groupBy("url").agg(F.min_by("role", "ord").alias("role"), F.min("ord").alias("ord"), last.alias("l"))
    open_ = F.coalesce(F.col("l.status"), F.lit("PENDING")) == "PENDING"
    return log.select("url", "role", "ord", F.when(open_, "SKIPPED").otherwise(F.col("l.status")).alias("status"), F.when(open_, "NOT_PROCESSED").otherwise(F.col("l.reason")).alias("reason"))


_EDGE = "(?:(?<![a-z0-9_])(?=[a-z0-9_])|(?<=[a-z0-9_])(?![a-z0-9_]))"


def mentions(pages: DataFrame, names: DataFrame) -> DataFrame:
    """pages (site_id, id, text) and names (site_id, name): which names, alone or with a plural s, a text has, literally and between
    word edges. A hyphen in a name stands for a space; names of under three characters don't count.

    The distinct words of texts are joined with the names' first words on equality, so that neither side is looped over;
    only texts that have a name's first word are searched for the name."""
    low = names.select("site_id", F.trim(F.replace(F.lower("name"), F.lit("-"), F.lit(" "))).alias("name")).filter(F.length("name") >= 3).distinct()
    first = F.regexp_extract("name", "[a-z0-9_]+", 0)
    keys = F.when((first != "") & F.endswith("name", first), F.array(first, F.concat(first, F.lit("s")))).otherwise(F.array(first))
    known = low.select("site_id", "name", F.explode(keys).alias("key"))
    # The empty word is every text's, for names without a word.
    words = F.array_union(F.split(F.lower("text"), "[^a-z0-9_]+"), F.array(F.lit("")))
    met = pages.select("site_id", "id", F.explode(words).alias("key")).join(known, ["site_id", "key"])
    asked = met.groupBy("site_id", "id").agg(F.collect_set("name").alias("names"))
    literal = lambda n: F.concat(F.lit(_EDGE), F.regexp_replace(n, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit("s?" + _EDGE))
    said = pages.withColumn("text", F.lower("text")).join(asked, ["site_id", "id"]).select("site_id", "id", F.explode(F.filter("names", lambda n: F.regexp("text", literal(n)))).alias("name"))
    return said.groupBy("site_id", "id").agg(F.sort_array(F.collect_set("name")).alias("names"))
