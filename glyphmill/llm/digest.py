"""Quartile bucket digests of whole texts, and their bounded difference score.

A digest counts hashed byte triplets (all of three bytes in a sliding window of
five that keep the first byte) in BUCKETS buckets, writes for every bucket which
quartile of all the counts its count is in (two bits), and adds the length on a
logarithmic scale and the ratios of the quartiles. Two digests are compared
bucket by bucket, with 1, 2 or 6 points for 1, 2 or 3 quartiles apart, and a few
points for length and ratios; the score is bounded, and likeness is 1 minus the
score's share of its bound.

Every text is also compared with the next one by doc_id, and with an edit of
itself whose tail comes from the next one, so the table is read in doc_id order:
texts go, once, to the range of ids that theirs is in; the smallest id's row of
each range also goes to the range before it. That is one row a range.

Edges: a null text is empty; null doc_ids sort first; rows of one doc_id are
ordered by text; the last document's next one is the first; a table of one row is
its own next; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, documents, id_and_text, shuffle_partitions, strings

BUCKETS = 256
#: Points for quartiles 0, 1, 2, 3 apart; most points of the length and of each ratio.
POINTS = (0, 1, 2, 6)
LENGTH_POINTS, RATIO_POINTS = 24, 12
BOUND = BUCKETS * POINTS[3] + LENGTH_POINTS + 2 * RATIO_POINTS
_OFFSETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_SALTS = (0x2B0B, 0x5D3F, 0x7A61, 0x3C95, 0x6E57, 0x4F1D)
_APART = np.array([[POINTS[abs(a - b)] for b in range(4)] for a in range(4)], np.int64)


def bucket_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    for (i, j), salt in zip(_OFFSETS, _SALTS, strict=True):
        n = len(b) - j
        if n > 0:
            h = (b[:n] * np.uint32(0x9E3B) + b[i : i + n]) * np.uint32(0x85EBCA6B) + b[j:] * np.uint32(salt * 0x10001)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(text: str) -> str:
    """Hexadecimal: length byte, ratio byte, then BUCKETS quartiles of two bits."""
    data = text.encode("utf-8")
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    quartile = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(12 * math.log2(len(data) + 1)))
    ratios = (16 * q1 // (q3 + 1) % 16) << 4 | 16 * q2 // (q3 + 1) % 16
    packed = quartile[0::4] | quartile[1::4] << 2 | quartile[2::4] << 4 | quartile[3::4] << 6
    return bytes([length, ratios]).hex() + packed.astype(np.uint8).tobytes().hex()


def _quartiles(packed: bytes) -> np.ndarray:
    p = np.frombuffer(packed, np.uint8)
    return np.stack([p & 3, p >> 2 & 3, p >> 4 & 3, p >> 6], axis=1).ravel()


def difference(a: str, b: str) -> int:
    """0 (alike) to BOUND."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    out = int(_APART[_quartiles(x[2:]), _quartiles(y[2:])].sum())
    out += min(LENGTH_POINTS, abs(x[0] - y[0]))
    out += min(RATIO_POINTS, abs((x[1] >> 4) - (y[1] >> 4))) + min(RATIO_POINTS, abs((x[1] & 15) - (y[1] & 15)))
    return out


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_ranges(docs: DataFrame) -> DataFrame:
    """(range, doc_id, text, own): all rows of a range in one partition, in order; own is false for the row after it."""
    spark = docs.sparkSession
    rows = id_and_text(docs)
    n = 4 * shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n)).first()[0]
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def place(ids) -> tuple[np.ndarray, np.ndarray]:
        """(range of each id, whether it is null); null ids have range 0 for themselves."""
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        return np.where(null, 0, np.searchsorted(cuts, known, side="right") + 1), null

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(place(ids)[0], pa.int32())

    # One row a range: its smallest id. Which of several rows of that id comes first is settled by sorting.
    dealt = rows.select("doc_id").withColumn("range", range_of("doc_id"))
    firsts = sorted((r["range"], r["id"]) for r in dealt.groupBy("range").agg(F.min("doc_id").alias("id")).collect())
    ranges = np.array([k for k, _ in firsts], np.int64)
    smallest = np.array([v or 0 for _, v in firsts], np.int64)

    @F.arrow_udf("array<int>")
    def ranges_of(ids: pa.Array) -> pa.Array:
        own, null = place(ids)
        k = np.searchsorted(ranges, own)
        first = null | (pc.fill_null(ids, 0).to_numpy(zero_copy_only=False) == smallest[k])
        values = np.stack([own, ranges[k - 1]], axis=1)  # before the first range comes the last
        keep = np.stack([np.ones(len(own), bool), first], axis=1)
        return pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(keep.sum(axis=1))]), pa.int32()), pa.array(values[keep], pa.int32())
        )

    # own: whether a row is in its own range, and not the copy that closes the range before.
    return (
        rows.withColumn("to", ranges_of("doc_id"))
        .select("doc_id", "text", F.posexplode("to").alias("copy", "range"))
        .select("range", "doc_id", "text", (F.col("copy") == 0).alias("own"))
        .repartition(shuffle_partitions(spark), "range")
        .sortWithinPartitions(F.col("range"), F.col("own").desc(), F.col("doc_id"), F.col("text"))
    )


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches):
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def result(one, two):
            doc_id, text, mark = one
            changed = edited(text, two[1])
            new = digest(changed)
            return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, new, likeness(mark, new), likeness(mark, two[2]))

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows, held, at, closed = [], None, None, False
        for batch in batches:
            for part in batches_of(batch):
                for key, doc_id, text, own in zip(*(part.column(c).to_pylist() for c in ("range", "doc_id")), strings(part.column("text")), part.column("own").to_pylist(), strict=True):
                    if closed and key == at:
                        continue  # further rows of the id that closes the range
                    row = (doc_id, text, digest(text))
                    if held is not None:
                        rows.append(result(held, row))
                    held, at, closed = (row, key, False) if own else (None, key, True)
                if rows:
                    yield emit(rows)
                    rows = []

    return in_ranges(docs).mapInArrow(run, RESULT)


def op5_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
