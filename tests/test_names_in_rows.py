"""Repetition of names in rows and in arrays is the same."""

import random

from pyspark.sql import functions as F

from glyphmill.operators import scoring


def test_repetition_of_rows(spark):
    rng = random.Random(1)
    rows = [(s, rng.choice(["a", "b", "c", "d", "e", None])) for s in range(40) for _ in range(rng.randint(1, 6))]
    frame = spark.createDataFrame(rows, "site int, name string")
    long = {r.site: r.consistency for r in scoring.repetition_of(frame, ["site"], "name").collect()}
    # collect_list leaves nulls out, so they go in as structs.
    names = frame.groupBy("site").agg(F.transform(F.collect_list(F.struct("name")), lambda x: x["name"]).alias("names"))
    assert long == {r.site: r.x for r in names.select("site", scoring.repetition("names").alias("x")).collect()}
