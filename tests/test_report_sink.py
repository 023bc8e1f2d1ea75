"""The sink of reports: whole files, all of a write or none, also where a task fails."""

import json
import os

import pytest
from pyspark.sql import functions as F

from glyphmill.sources import report_sink


def names(folder):
    return sorted(f for f in os.listdir(folder) if f.endswith(".json"))


def test_a_file_for_each_site(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a.com", 1.5), ("b/ü", 2.0), (None, 3.0), ("a.com", 1.5)], "site_id string, score double").repartition(3)
    report_sink.write_site_reports(rows, path)
    assert names(path) == ["a.com.json", "b%2F%C3%BC.json"]
    read = json.loads((tmp_path / "out" / "b%2F%C3%BC.json").read_text())
    assert read["report"] == {"site_id": "b/ü", "score": 2.0} and read["export_format_version"] == 1
    # A later write replaces a site's file and leaves the others.
    report_sink.write_site_reports(spark.createDataFrame([("a.com", 9.0)], "site_id string, score double"), path)
    assert json.loads((tmp_path / "out" / "a.com.json").read_text())["report"]["score"] == 9.0 and len(names(path)) == 2
    assert sum(f.startswith("_SUCCESS-") for f in os.listdir(path)) == 2 and os.listdir(tmp_path / "out" / "_attempts") == []


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(0, 40, numPartitions=4).select(F.concat(F.lit("s"), "id").alias("site_id"), F.when(F.col("id") == 39, F.raise_error(F.lit("no"))).otherwise(F.lit(1)).alias("score"))
    with pytest.raises(Exception, match="no"):
        report_sink.write_site_reports(rows, path)
    assert not os.path.isdir(path) or (names(path) == [] and not any(f.startswith("_SUCCESS") for f in os.listdir(path)))
    assert not os.path.isdir(path + "/_attempts") or os.listdir(path + "/_attempts") == []


def test_attempts_that_repeat_count_once(tmp_path):
    class Row(dict):
        pass

    writer = report_sink.SiteReportsWriter(str(tmp_path / "o"), "w")
    first = writer.write(iter([Row(site_id="a", payload="old"), Row(site_id="gone", payload="x")]))
    second = writer.write(iter([Row(site_id="a", payload="new")]))
    assert first.folder != second.folder and not names(tmp_path / "o")
    writer.commit([second, None])
    assert names(tmp_path / "o") == ["a.json"] and (tmp_path / "o" / "a.json").read_text() == "new"


def test_an_empty_table(spark, tmp_path):
    report_sink.write_site_reports(spark.createDataFrame([], "site_id string, score double"), str(tmp_path / "o"))
    assert names(tmp_path / "o") == []


def test_an_abort_while_tasks_write(tmp_path):
    writer = report_sink.SiteReportsWriter(str(tmp_path / "o"), "w")

    def rows():
        yield {"site_id": "a", "payload": "x"}
        writer.abort([])
        yield {"site_id": "b", "payload": "x"}

    with pytest.raises(OSError):
        writer.write(rows())
    with pytest.raises(OSError):
        writer.write(iter([{"site_id": "late", "payload": "x"}]))
    assert os.listdir(tmp_path / "o" / "_attempts") == [] and names(tmp_path / "o") == []
