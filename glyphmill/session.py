"""Spark session used by tests, the bench and interactive work.

On a cluster the session comes from spark-submit; every module takes it as an
argument and reads its settings instead of assuming local ones.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "glyphmill", **conf: str) -> SparkSession:
    """A local session with the settings that the engine is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GLYPHMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names, which the driver and all executors share. Only in a local session, where that may be
    unset, a temporary folder is taken."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    return f"{path.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder that spark.checkpoint.dir names, so that several readers don't repeat it and a lost executor
    costs a reread. Only where that is unset (tests, notebooks) a local folder is taken."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or shared_folder(df.sparkSession))
    return df.checkpoint()
