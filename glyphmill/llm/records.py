"""Length-delimited binary records of token ids, with a separate offset index.

File format (all numbers little-endian)::

    shard.rec   frame*
    frame       u64 length of data | u32 masked crc of those 8 bytes | data | u32 masked crc of data
    data        u8 flags (1: no doc_id, 2: ids as u16) | i64 doc_id | ids as u16 or u32
    shard.idx   entry*
    entry       i64 doc_id | u64 offset of the frame in shard.rec | u64 ids in the frame

The masked checksum of bytes is ``rot17(crc32) + 0xA282EAD8``, so that a checksum
stored among data doesn't look like that data's own. Ids take 16 bits in
vocabularies of at most 65,536 ids, else 32; every record says which.

Scale: documents are range-partitioned by doc_id once (the only shuffle of
texts); each task streams its range into shards of a bounded size in the
cluster's shared folder and returns one manifest row a shard. The manifest is
the commit record: shards of lost or repeated task attempts have other names and
are never listed. Global starts are a running sum over manifest rows, one a
shard of 64 MB, not over documents.

Nulls and edges: a null text is written as the empty text (one end id); a null
doc_id sorts first and comes back as null; repeated rows give one record each;
an empty table gives no shard and no row; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm import tokens
from glyphmill.llm.common import documents, file_system, id_and_text, new_path, shuffle_partitions, store

SHARD_BYTES = 64 << 20
_NO_ID, _SHORT = 1, 2
_HEAD, _DATA, _ENTRY = struct.Struct("<QI"), struct.Struct("<Bq"), struct.Struct("<qQQ")
MANIFEST = "part long, shard long, path string, n_docs long, n_tokens long, n_bytes long"


class BadRecord(ValueError):
    """A frame whose checksum or length is wrong."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked(length)), data, struct.pack("<I", masked(data))))


def pack(doc_id: int | None, ids: bytes, short: bool) -> bytes:
    """ids: little-endian u32."""
    flags = _NO_ID * (doc_id is None) | _SHORT * short
    body = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if short else ids
    return _DATA.pack(flags, doc_id or 0) + body


def unpack(data: bytes) -> tuple[int | None, bytes]:
    """(doc_id, ids as little-endian u32)"""
    flags, doc_id = _DATA.unpack_from(data)
    body = data[_DATA.size :]
    return None if flags & _NO_ID else doc_id, np.frombuffer(body, "<u2").astype("<u4").tobytes() if flags & _SHORT else body


def read_frame(f) -> bytes | None:
    head = f.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size or masked(head[:8]) != _HEAD.unpack(head)[1]:
        raise BadRecord("the length's checksum is wrong")
    data, crc = f.read(_HEAD.unpack(head)[0]), f.read(4)
    if len(crc) < 4 or masked(data) != struct.unpack("<I", crc)[0]:
        raise BadRecord("the data's checksum is wrong")
    return data


def read_shard(path: str) -> Iterator[tuple[int | None, bytes]]:
    """All records of a shard in the order written, every checksum checked."""
    fs, where = file_system(path)
    with fs.open_input_stream(where, buffer_size=1 << 20) as f:
        while (data := read_frame(f)) is not None:
            yield unpack(data)


def read_index(path: str) -> np.ndarray:
    fs, where = file_system(path + ".idx")
    with fs.open_input_stream(where) as f:
        return np.frombuffer(f.read(), dtype=[("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])


def read_shuffled(path: str, seed: int) -> Iterator[tuple[int | None, bytes]]:
    """All records of a shard in a random order, each sought by its offset in the index."""
    index = read_index(path)
    fs, where = file_system(path)
    with fs.open_input_file(where) as f:
        for k in np.random.default_rng(seed).permutation(len(index)):
            f.seek(int(index["offset"][k]))
            yield unpack(read_frame(f))


class ShardWriter:
    """Writes shard files of about most bytes; shards is one manifest tuple for each closed file."""

    def __init__(self, folder: str, part: int, short: bool, most: int = SHARD_BYTES):
        self._folder, self._part, self._short, self._most = folder, part, short, most
        self._attempt, self._file, self.shards = uuid.uuid4().hex, None, []

    def _open(self) -> None:
        self._path = f"{self._folder}/part-{self._part:06d}-{len(self.shards):05d}-{self._attempt}.rec"
        fs, where = file_system(self._path)
        fs.create_dir(os.path.dirname(where), recursive=True)
        self._file, self._index = fs.open_output_stream(where), fs.open_output_stream(where + ".idx")
        self._at = self._docs = self._ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self._file is None:
            self._open()
        data = frame(pack(doc_id, ids, self._short))
        self._file.write(data)
        self._index.write(_ENTRY.pack(doc_id or 0, self._at, len(ids) // 4))
        self._at, self._docs, self._ids = self._at + len(data), self._docs + 1, self._ids + len(ids) // 4
        if self._at >= self._most:
            self.close()

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self._index.close()
            self.shards.append((self._part, len(self.shards), self._path, self._docs, self._ids, self._at))
            self._file = None


def write_records(docs: DataFrame, vocabulary: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode documents in ascending doc_id order into shards; returns the stored manifest (MANIFEST)."""
    spark = docs.sparkSession
    folder = new_path(spark, "records")
    end = np.array([tokens.END_ID], "<u4").tobytes()

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        short = tokens.encoder(vocabulary).size <= 1 << 16
        out = ShardWriter(folder, TaskContext.get().partitionId(), short, most=shard_bytes)
        for part, ids in tokens.encoded(batches, vocabulary):
            for doc_id, own in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                out.add(doc_id, own + end)
        out.close()
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        columns = list(zip(*out.shards, strict=True)) or [[] for _ in names]
        kinds = [pa.string() if n == "path" else pa.int64() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return store(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read back from the shards that the manifest lists."""
    starts = manifest.withColumn("start", F.sum("n_tokens").over(Window.orderBy("part", "shard")) - F.col("n_tokens"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in read_shard(path):
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    # A manifest row is one 64 MB read, so rows are dealt out one by one.
    return (
        starts.select("path", "start")
        .repartition(shuffle_partitions(manifest.sparkSession))
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_records(documents(spark, sf_dir), tokens.vocabulary()))
