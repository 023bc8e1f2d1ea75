"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents, in doc_id order, are cut in blocks. Block i = 1, 2, ... of a
source of weight w has release floor((i-1)/w) and deadline ceil(i/w); one block
runs in each time slot, the released one of the earliest deadline. As the weights
sum to one, every deadline is met, so after any number of slots each source has
had its share to within less than one block (Baruah, Cohen, Plaxton, Varvel 1996).

Weights are the target weights themselves, to DIGITS decimals, and slots are scheduled up to
the horizon, the slot at which the first source runs out. Every document stays: later
blocks follow by deadline.

Scale: a slot depends on the one before, so slots are simulated one after the other, in sections of
SECTION slots, each an ``aggregate`` over a single row that carries the turns of all sources; its
cost is linear in slots times sources and independent of the documents' sizes. ``block`` sets the number of
slots: at 5e9 documents take blocks of thousands. All else is
distributed: documents are numbered within (source, range of ids), the ranges cut at quantiles, so that
neither a source with a third of all rows nor an outlying id makes one task; positions come
from sums over slots in two levels. At most a row a source is collected, for each section.

Edges: null and empty sources are one source; null doc_ids come first; repeated
rows are rows of their own; one source alone has every slot; an empty table gives
no row; other columns pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import documents, keep

BLOCK, RANGES, DIGITS = 16, 1024, 10
#: Slots of a section, and of a chunk of it: what a slot adds is copied within its chunk only.
SECTION, CHUNK = 16_384, 128
#: Target weight of a source without a given one: the square root of its documents, which lifts small sources.
POWER = 0.5


def targets(counts: DataFrame, weights: dict[str, float] | None = None, power: float = POWER) -> DataFrame:
    """counts: (source, n). (source, n, number, weight, whole): the target weight is weight / whole, both whole numbers."""
    given = F.lit(None).cast("double")
    if weights:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("source")].cast("double")
    raw = counts.withColumn("w", F.coalesce(given, F.pow(F.col("n"), F.lit(power))))
    every = Window.partitionBy()
    ordered = every.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.greatest(F.lit(1), F.round(F.col("w") / F.sum("w").over(ordered) * 10**DIGITS).cast("long")).cast("long")
    return raw.withColumn("weight", share).select("source", "n", F.row_number().over(every.orderBy("source")).alias("number"), "weight", F.sum("weight").over(every).alias("whole"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def sections(target: DataFrame, block: int = BLOCK, section: int = SECTION) -> tuple[DataFrame, int]:
    """(number, turn, slot) of the slots before the horizon, and the horizon."""
    spark = target.sparkSession
    rows = target.orderBy("number").collect()
    blocks = [-(-x["n"] // block) for x in rows]
    turns, at, horizon, done = [0] * len(rows), 0, None, None
    section = min(section, -(-(sum(blocks) + 1) // CHUNK) * CHUNK)  # no later than with the last block does a source run out
    sources = F.array(*[F.struct(F.lit(x["number"]).alias("number"), F.lit(x["weight"]).cast("long").alias("weight")) for x in rows])
    whole = F.lit(rows[0]["whole"]).cast("long") if rows else None
    ran = "array<struct<number:int,turn:bigint,slot:bigint>>"

    def step(state: Column, slot: Column) -> Column:
        def candidate(x: Column) -> Column:
            turn = F.element_at(state["turns"], x["number"])
            # floor(turn / w) <= slot and ceil((turn + 1) / w) in whole numbers: long division, as doubles are too short.
            released = turn * whole < (slot + 1) * x["weight"]
            deadline = F.call_function("div", (turn + 1) * whole + x["weight"] - 1, x["weight"])
            return F.when(released, F.struct(deadline.alias("deadline"), x["number"].alias("number")))

        def after(own: Column) -> Column:
            return F.struct(
                F.transform(state["turns"], lambda t, k: t + (k + 1 == own).cast("long")).alias("turns"),
                F.concat(state["ran"], F.array(F.struct(own.alias("number"), (F.element_at(state["turns"], own) + 1).alias("turn"), slot.alias("slot")))).alias("ran"),
            )

        return once(F.array_min(F.transform(F.col("all"), candidate))["number"], after)

    def chunk(state: Column, first: Column) -> Column:
        slots = F.sequence(first, first + CHUNK - 1)
        own = F.aggregate(slots, F.struct(state["turns"].alias("turns"), F.array().cast(ran).alias("ran")), step)
        return once(own, lambda x: F.struct(x["turns"].alias("turns"), F.concat(state["chunks"], F.array(x["ran"])).alias("chunks")))

    while rows and horizon is None:
        start = F.struct(F.array(*[F.lit(t).cast("long") for t in turns]).alias("turns"), F.array().cast(f"array<{ran}>").alias("chunks"))
        firsts = F.sequence(F.lit(at).cast("long"), F.lit(at + section - 1).cast("long"), F.lit(CHUNK).cast("long"))
        one = keep(spark.range(1, numPartitions=1).select(sources.alias("all")).select(F.aggregate(firsts, start, chunk).alias("s")).select("s.*"))
        slots = one.select(F.inline(F.flatten("chunks")))
        turns = one.first()["turns"]
        if any(t > b for t, b in zip(turns, blocks, strict=True)):
            last = F.element_at(F.array(*[F.lit(b).cast("long") for b in blocks]), F.col("number"))
            horizon = slots.filter(F.col("turn") > last).agg(F.min("slot").alias("h")).first()["h"]
            slots = slots.filter(F.col("slot") < horizon)
        done = slots if done is None else done.unionByName(slots)
        at += section
    return (spark.createDataFrame([], "number int, turn long, slot long") if done is None else done), horizon or 0


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most value (null: -1), by binary search."""
    if not cuts:
        return F.when(value.isNull(), -1).otherwise(0)
    ends = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def step(at: Column, by: Column) -> Column:
        further = at + by
        return F.when((further <= len(cuts)) & (F.get(ends, further - 1) <= value), further).otherwise(at)

    return F.when(value.isNull(), -1).otherwise(F.aggregate(steps, F.lit(0), step))


def numbered(df: DataFrame, key: str, number: str, ranges: int = RANGES) -> DataFrame:
    """Adds _gm_nth: 0, 1, ... within key, in ascending order of the long column number. Rows are sorted in (key, range of
    numbers) only; the ranges are cut at quantiles, and their counts give the rest."""
    cuts = df.agg(F.percentile_approx(number, [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0]
    dealt = df.withColumn("_gm_range", range_of(F.col(number), sorted(set(cuts or []))))
    counts = dealt.groupBy(key, "_gm_range").agg(F.count("*").alias("_gm_n"))
    before = counts.select(
        F.col(key).alias("_gm_key"), F.col("_gm_range").alias("_gm_r"),
        (F.sum("_gm_n").over(Window.partitionBy(key).orderBy("_gm_range")) - F.col("_gm_n")).alias("_gm_before"),
    )
    own = F.row_number().over(Window.partitionBy(key, "_gm_range").orderBy(number))
    return (
        dealt.withColumn("_gm_own", own)
        .join(before, (F.col(key) == F.col("_gm_key")) & (F.col("_gm_range") == F.col("_gm_r")))
        .withColumn("_gm_nth", F.col("_gm_before") + F.col("_gm_own") - 1)
        .drop("_gm_key", "_gm_r", "_gm_before", "_gm_own", "_gm_range")
    )


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, block: int = BLOCK, carry: bool = True) -> DataFrame:
    """docs with _gm_source, _gm_block (from 0), _gm_in_block, _gm_slot and _gm_horizon. carry: with all columns, or doc_id alone."""
    kept = docs if carry else docs.select("doc_id", "source")
    rows = kept.withColumn("_gm_source", F.coalesce(F.col("source"), F.lit(""))).withColumn("_gm_id", F.col("doc_id").cast("long"))
    counts = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    target = keep(targets(counts, weights, power))
    table, horizon = sections(target, block)
    slots = table.join(target.select("number", "source"), "number").select(
        F.col("source").alias("_gm_s"), (F.col("turn") - 1).alias("_gm_b"), F.col("slot").alias("_gm_slot")
    )
    own = target.select(
        F.col("source").alias("_gm_q"), F.col("number").alias("_gm_number"), F.col("weight").alias("_gm_weight"), F.col("whole").alias("_gm_whole"),
        F.count("*").over(Window.partitionBy()).alias("_gm_sources"),
    )
    # Left over, a block's deadline is over the horizon; each has a number of its own, in order of deadlines.
    deadline = F.call_function("div", (F.col("_gm_block") + 1) * F.col("_gm_whole") + F.col("_gm_weight") - 1, F.col("_gm_weight"))
    later = F.lit(horizon) + (deadline - 1 - horizon) * F.col("_gm_sources") + F.col("_gm_number") - 1
    return (
        numbered(rows, "_gm_source", "_gm_id")
        .withColumn("_gm_block", F.floor(F.col("_gm_nth") / block))
        .withColumn("_gm_in_block", F.col("_gm_nth") % block)
        .join(own, F.col("_gm_source") == F.col("_gm_q"))
        .join(slots, (F.col("_gm_source") == F.col("_gm_s")) & (F.col("_gm_block") == F.col("_gm_b")), "left")
        .withColumn("_gm_slot", F.coalesce("_gm_slot", later))
        .withColumn("_gm_horizon", F.lit(horizon).cast("long"))
        .drop("_gm_id", "_gm_q", "_gm_s", "_gm_b", "_gm_nth", "_gm_number", "_gm_weight", "_gm_whole", "_gm_sources")
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, block, slot, position, in_mix): position is the document's place, from 0, in the mixed stream."""
    placed = keep(mixed(docs, carry=False, **options))
    slots = placed.groupBy(F.col("_gm_slot").alias("s")).agg(F.count("*").alias("n")).withColumn("g", F.floor(F.col("s") / 256))
    groups = slots.groupBy("g").agg(F.sum("n").alias("m"))
    # One row for 256 slots, or 256 blocks of documents.
    group_before = groups.select(F.col("g").alias("h"), (F.sum("m").over(Window.orderBy("g")) - F.col("m")).alias("earlier"))
    within = slots.withColumn("sofar", F.sum("n").over(Window.partitionBy("g").orderBy("s")) - F.col("n"))
    before = within.join(group_before, within["g"] == group_before["h"]).select("s", (F.col("earlier") + F.col("sofar")).alias("before"))
    return placed.join(before, F.col("_gm_slot") == F.col("s")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_gm_source").alias("source"), F.col("_gm_block").cast("long").alias("block"),
        F.col("_gm_slot").cast("long").alias("slot"), (F.col("before") + F.col("_gm_in_block")).cast("long").alias("position"),
        (F.col("_gm_slot") < F.col("_gm_horizon")).alias("in_mix"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs, all rows and columns, in the order of the mixed stream: range-partitioned and sorted by slot, so the files that
    are written of it can be read as the stream (``packing.pack_stream`` does)."""
    placed = mixed(docs, **options)
    return placed.repartitionByRange("_gm_slot", "_gm_in_block").sortWithinPartitions("_gm_slot", "_gm_in_block").select(docs.columns)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(documents(spark, sf_dir))


ORACLE = f"""
WITH RECURSIVE counts AS (
  SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1
), raw AS (
  SELECT source, n, pow(n, {POWER}) AS w FROM counts
), target AS (
  SELECT source, n, row_number() OVER (ORDER BY source) AS number, greatest(1, CAST(round(w / sum(w ORDER BY source) OVER () * {10**DIGITS}) AS BIGINT)) AS weight FROM raw
), lists AS (
  SELECT list(weight ORDER BY number) AS weights, CAST(sum(weight) AS BIGINT) AS whole, list((n + {BLOCK - 1}) // {BLOCK} ORDER BY number) AS blocks, count(*) AS k FROM target
), run AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS ran, list_transform(weights, lambda x: CAST(0 AS BIGINT)) AS turns FROM lists
  UNION ALL
  SELECT slot, ran, list_transform(turns, lambda t, i: t + CASE WHEN i = ran THEN 1 ELSE 0 END) FROM (
    SELECT r.slot + 1 AS slot, r.turns,
      list_sort(list_filter(list_transform(r.turns, lambda t, i:
        CASE WHEN t * l.whole < (r.slot + 2) * l.weights[i]
             THEN {{'deadline': ((t + 1) * l.whole + l.weights[i] - 1) // l.weights[i], 'number': i}} END), lambda x: x IS NOT NULL))[1].number AS ran
    FROM run r, lists l WHERE len(list_filter(list_zip(r.turns, l.blocks), lambda z: z[1] > z[2])) = 0) AS s
), horizon AS (
  SELECT max(slot) AS horizon FROM run
), plan AS (
  SELECT t.source, r.slot, row_number() OVER (PARTITION BY t.source ORDER BY r.slot) - 1 AS block
  FROM run r JOIN target t ON t.number = r.ran, horizon WHERE r.slot >= 0 AND r.slot < horizon
), nth AS (
  SELECT doc_id, coalesce(source, '') AS source,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id NULLS FIRST) - 1 AS nth FROM documents
), placed AS (
  SELECT d.doc_id, d.source, d.nth // {BLOCK} AS block, d.nth % {BLOCK} AS in_block, h.horizon,
         coalesce(p.slot, h.horizon + (((d.nth // {BLOCK} + 1) * l.whole + t.weight - 1) // t.weight - 1 - h.horizon) * l.k + t.number - 1) AS slot
  FROM nth d JOIN target t ON t.source = d.source LEFT JOIN plan p ON p.source = d.source AND p.block = d.nth // {BLOCK}, lists l, horizon h
)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot,
       CAST(row_number() OVER (ORDER BY slot, in_block) - 1 AS BIGINT) AS position, slot < horizon AS in_mix
FROM placed
"""
