"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space at both ends, with A-Z
lower-cased; only keys of at least LEAST code points count. Every key is a
128-bit hash. ``LineRuns`` keeps runs sorted by hash on the executors' disks, with the lineage
that computes what a lost executor held: one row a key with the number of documents it adds and the largest doc_id of those.

* ``add(batch)`` counts the batch's keys and merge-anti-joins them with the runs: a key that
  no run has is *new*, and the batch's largest doc_id with it is its first holder, for good.
  The batch's own run has its new keys with their first holders, and what it adds to the
  counts of older keys, without one.
* After FANOUT runs on a level, they are merged into one run of the next level.

All runs are hash-partitioned by key in the same way and sorted by it, so joins and merges
of runs take no exchange and no sort: only a new batch's keys are shuffled. A
stream of batches thus costs one merge join with a logarithmic number of runs each. The
table query adds the documents in BATCHES batches of descending doc_id, so that
the first sighting is the largest doc_id, merges the runs, and drops lines whose key is in
LEAST_DOCUMENTS documents from all but their holder.

Scale: per line, 24 bytes are shuffled; a task sums its keys before they are dealt by key, so a line
that every document has is a row a task (and SUMMED rows) there; the
join that a very frequent key skews is a plain sort-merge join, which adaptive
execution splits; whole texts are shuffled once, to meet their own dropped keys.

Edges: a null or empty text is one empty line; lines of one document count once;
rows of one doc_id are one document in counts and keep rows of their own; a null
doc_id is below every other (its lines go when other documents hold them); an
empty table gives no row; other columns pass through ``dedup`` untouched.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, documents, keep, shuffle_partitions, store, strings, text_or_empty

# Fixed values of the contract.
SPACE = b" \t\n\x0b\x0c\r"
LEAST, LEAST_DOCUMENTS = 20, 3

BATCHES, FANOUT = 4, 2
#: Rows that a task sums at once.
SUMMED = 200_000
_NO_ID = -(1 << 63)


def keys_of(text: str) -> list[bytes | None]:
    """For each line the 16-byte hash of its key, None where the key is short."""
    import xxhash

    out: list[bytes | None] = []
    for line in text.encode("utf-8").split(b"\n"):
        key = line.strip(SPACE)
        # Under LEAST bytes it is under LEAST code points; past four times that it can't be.
        if len(key) < LEAST or (len(key) < 4 * LEAST and len(key.decode("utf-8")) < LEAST):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key.lower()))
    return out


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, key): the distinct keys of each document; a null doc_id becomes the smallest long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in batches_of(batch):
                ids, keys = [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), strings(part.column("text")), strict=True):
                    own = set(keys_of(text))
                    own.discard(None)
                    ids += [doc_id] * len(own)
                    keys += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    known = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)).alias("doc_id"), text_or_empty(docs).alias("text"))
    return known.mapInArrow(run, "doc_id long, key binary")


def summed(keys: DataFrame) -> DataFrame:
    """keys: (doc_id, key), distinct. (key, n, holder): what each task has of a key, not yet added up over tasks."""

    def run(batches):
        import pyarrow as pa

        def total(held):
            own = pa.Table.from_batches(held).group_by("key", use_threads=False).aggregate([("doc_id", "count"), ("doc_id", "max")])
            yield from own.select(["key", "doc_id_count", "doc_id_max"]).rename_columns(["key", "n", "holder"]).to_batches()

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SUMMED:
                yield from total(held)
                held, rows = [], 0
        if held:
            yield from total(held)

    return keys.select("doc_id", "key").mapInArrow(run, "key binary, n long, holder long")


class LineRuns:
    """Levelled sorted runs of (key, n, holder, new, first): documents, the largest of them, whether no older run has the key, and
    the largest document of the batch in which that was so (null: an older run has it)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self._parts, self._fanout = shuffle_partitions(spark), fanout
        self._levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self._levels for run in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """keys: (doc_id, key), distinct. Returns the batch's own run; its new rows are keys not seen before."""
        dealt = summed(keys).repartition(self._parts, "key").groupBy("key").agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))
        own = keep(dealt.sortWithinPartitions("key"))
        fresh = own
        for run in self.runs():
            fresh = fresh.join(run.select("key").hint("merge"), "key", "left_anti")
        if self._levels:
            run = keep(own.join(fresh.select("key", F.col("holder").alias("first")).hint("merge"), "key", "left").withColumn("new", F.col("first").isNotNull()))
        else:
            run = own.withColumn("first", F.col("holder")).withColumn("new", F.lit(True))
        self._put(run, 0)
        return run

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self._levels):
            self._levels.append([])
        self._levels[level].append(run)
        if len(self._levels[level]) >= self._fanout:
            merged, self._levels[level] = self._merged(self._levels[level]), []
            self._put(keep(merged), level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            more = b.select("key", *[F.col(c).alias(f"{c}_b") for c in ("n", "holder", "new", "first")])
            return a.join(more.hint("merge"), "key", "full").select(
                "key", (F.coalesce("n", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"), F.greatest("holder", "holder_b").alias("holder"),
                (F.coalesce("new", F.lit(False)) | F.coalesce("new_b", F.lit(False))).alias("new"), F.coalesce("first", "first_b").alias("first"),
            )

        return reduce(two, runs)

    def counts(self) -> DataFrame:
        """(key, n documents, holder, first) over all batches."""
        return self._merged(self.runs()).select("key", "n", "holder", "first")


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """doc_ids that cut the table in batches of about equal size, ascending."""
    cuts = docs.agg(F.percentile_approx(F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)), [k / batches for k in range(1, batches)], 1000)).first()[0]
    return sorted(set(cuts or []))


def dropped_keys(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, keys): for each document that loses lines, the keys of those lines."""
    spark = docs.sparkSession
    bounds = batch_bounds(docs, batches) if batches > 1 else []
    of_batch = F.lit(0)
    for bound in bounds:
        of_batch = of_batch + (F.col("doc_id") >= bound).cast("int")
    hashed = keep(line_keys(docs))
    runs = LineRuns(spark)
    for k in range(len(bounds), -1, -1):
        # Rows of one doc_id may lie in several tasks, and are one document.
        runs.add(hashed.filter(of_batch == k).distinct())
    frequent = store(runs.counts().filter(F.col("n") >= least_documents).select("key", F.col("first").alias("holder")), "frequent-lines")
    return (
        hashed.join(frequent.hint("merge"), "key")
        .filter(F.col("doc_id") != F.col("holder"))
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("keys"))
    )


def _with_dropped(docs: DataFrame, least_documents: int, batches: int) -> DataFrame:
    """All columns of docs and _gm_keys."""
    gone = dropped_keys(docs, least_documents, batches).select(F.col("doc_id").alias("_gm_id"), F.col("keys").alias("_gm_keys"))
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID))
    # Not a broadcast, whose size would follow the corpus; a document's keys are one row.
    return docs.join(gone.hint("merge"), own == gone["_gm_id"], "left").drop("_gm_id")


def kept_lines(text: str, gone: set[bytes]) -> tuple[str, int, int]:
    """(text without the lines of gone keys, lines before, lines dropped)"""
    lines = text.split("\n")
    if not gone:
        return text, len(lines), 0
    kept = [line for line, key in zip(lines, keys_of(text), strict=True) if key not in gone]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def dedup(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """docs, all columns, with the repeated lines taken out of text (and n_chars following, where it is a column)."""
    marked = _with_dropped(docs, least_documents, batches)
    at = docs.columns.index("text")

    def run(arrow):
        import pyarrow as pa

        for batch in arrow:
            for part in batches_of(batch):
                texts = strings(part.column(at))
                keys = part.column(part.num_columns - 1).to_pylist()
                new = [t if t is None or not k else kept_lines(t, set(k))[0] for t, k in zip(texts, keys, strict=True)]
                columns = [pa.array(new, pa.string()) if k == at else c for k, c in enumerate(part.columns[:-1])]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    out = marked.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def line_report(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))

    def run(arrow):
        import pyarrow as pa

        for batch in arrow:
            for part in batches_of(batch):
                rows = []
                for doc_id, text, keys in zip(part.column("doc_id").to_pylist(), strings(part.column("text")), part.column("_gm_keys").to_pylist(), strict=True):
                    kept, lines, gone = kept_lines(text, set(keys or ()))
                    rows.append((doc_id, lines, gone, hashlib.sha256(kept.encode()).hexdigest()))
                names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
                kinds = [pa.int64()] * 3 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _with_dropped(narrow, least_documents, batches).mapInArrow(run, RESULT)


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))
