"""Site documents, rules and reports as JSON: reading with a fixed schema, and the versioned export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import scoring

#: What may be named as a demonstration, the export's version, and the cuts of the public view.
DEMOS = ("good", "partial", "poor", "contradictory", "incomplete", "not_applicable", "not_evaluable", "d1_gate")
EXPORT_VERSION, MAX_HEADINGS, MAX_HEADING = 1, 40, 80


def documents(spark: SparkSession, path: str, *, one_per_file: bool = True) -> DataFrame:
    """Site documents of a folder or file. One that lacks its lists of components or tokens is no site document and fails the read of it alone:
    it comes with valid = false."""
    df = spark.read.schema(scoring.SITE).json(path, multiLine=one_per_file)
    return df.withColumn("valid", F.col("components").isNotNull() & F.col("tokens").isNotNull())


def demo(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in DEMOS:
        raise ValueError(f"no demonstration named {name!r}")
    return documents(spark, f"{folder.rstrip('/')}/{name}.json")


def weights(spark: SparkSession, path: str) -> DataFrame:
    """(dimension, w) from a JSON object of weights, which must add up to 1."""
    rows = spark.read.schema("weights map<string,double>").json(path, multiLine=True).select(F.explode("weights").alias("dimension", "w"))
    off = rows.agg(F.abs(F.sum("w") - 1).alias("off"))
    return rows.join(F.broadcast(off)).filter(F.when(F.col("off") <= 1e-6, True).otherwise(F.raise_error(F.lit("weights must add up to 1")).cast("boolean"))).select("dimension", "w")


def public_sources(sources: DataFrame) -> DataFrame:
    """sources without internal columns, headings cut."""
    heads = F.transform(F.slice(F.coalesce("headings", F.array()), 1, MAX_HEADINGS), lambda h: F.substring(h, 1, MAX_HEADING))
    return sources.select("url", "role", "status", "reason", F.coalesce("used_as", F.array().cast("array<string>")).alias("used_as"), heads.alias("headings"))


def exported(reports: DataFrame, mode: str = "live") -> DataFrame:
    """(site_id, payload): one self-describing JSON object a site."""
    head = [F.lit("glyphmill").alias("tool"), F.lit(EXPORT_VERSION).alias("export_format_version"), F.lit(1).alias("phase"), F.lit(mode).alias("mode")]
    return reports.select("site_id", F.to_json(F.struct(*head, F.struct(*[c for c in reports.columns]).alias("report"))).alias("payload"))


def write_reports(reports: DataFrame, path: str, mode: str = "live") -> None:
    """Exports as lines of JSON text."""
    exported(reports, mode).select(F.col("payload").alias("value")).write.mode("errorifexists").text(path)
