"""Shared pieces of the training-data operators: the cluster's shared folder,
written intermediate tables, and a text column without nulls.

Lineage is cut by writing a Parquet table (``store``) in the folder that
``spark.checkpoint.dir`` names, so a lost executor costs a reread and nothing
else. Only where that setting is missing (tests, notebooks) a local folder is
made and set as the checkpoint directory.

What is read more than once, but not from round to round, is kept on the executors' own
disks by ``keep``: it is not cut off from its lineage, so Spark computes again what a lost
executor held. ``release`` frees what is kept, for a job that goes on to something else.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_KEPT: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that the driver and all executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/glyphmill/{name}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """pyarrow's file system of a URI (local, hdfs, s3, gs ...) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df, of any types, as a Parquet table in the shared folder and return the table; partitions are numbered files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame, name: str, through: Callable[[Iterator], Iterator] | None = None, schema: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write df, an operator's own table of plain types, as Parquet files in the shared folder and return the table. What goes
    through a function of Arrow batches (to the schema) is written by the same Python worker.

    Each task writes a file, and the files that whole tasks report are the table, so those of lost and repeated attempts
    are never read. Tasks write from Python: on file systems without a native library the JVM starts a process for
    every file and folder that it makes, and while such a process starts, a large JVM counts twice."""
    spark, schema = df.sparkSession, schema or df.schema
    path = new_path(spark, name)

    def write(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        file, writer = f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet", None
        for batch in through(batches) if through else batches:
            if batch.num_rows:
                if writer is None:
                    fs, where = file_system(file)
                    fs.create_dir(os.path.dirname(where), recursive=True)
                    out = fs.open_output_stream(where)
                    writer = pq.ParquetWriter(out, batch.schema, compression=compression)
                writer.write_batch(batch)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file])], names=["file"])

    # The shuffle files of what is stored go when it is; else they stay until the driver happens to collect its garbage.
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        files = sorted(r["file"] for r in df.mapInArrow(write, "file string").collect())
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def keep(df: DataFrame) -> DataFrame:
    """df, computed once and kept on the executors' disks."""
    # What the session has cleared itself is let go, as a frame holds its plan in the driver.
    _KEPT[:] = [d for d in _KEPT if d.storageLevel.useDisk]
    _KEPT.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def release() -> None:
    """Frees all that is kept; frames made of it still work, by computing it again."""
    while _KEPT:
        _KEPT.pop().unpersist()


def discard(stored: DataFrame) -> None:
    """Deletes a table that ``store`` returned and nothing will read again."""
    spark = stored.sparkSession
    for folder in {os.path.dirname(f) for f in stored.inputFiles()}:
        if "/glyphmill/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string, null as empty); other columns are not read."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))


def strings(column) -> list[str | None]:
    """The values of an Arrow column of strings or bytes; several times as fast as to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


def trim() -> None:
    """Gives memory that a task is done with back to the system; Python workers stay alive between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def batches_of(batch, most_bytes: int = 1 << 20, column: str = "text"):
    """Slices of an Arrow batch whose texts (or bytes of another column) are about most_bytes, to bound what Python holds at once."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
