"""Near-duplicate documents by min-max hashing, links confirmed on whole shingle sets.

Signature: under each of PERMUTATIONS hash permutations both the minimum and the
maximum over a document's shingles are kept, so half the hash evaluations give a
signature whose rate of equal entries is an unbiased estimate of the Jaccard
similarity, with lower variance than as many entries from one permutation drawn
again. The 128 entries make 32 bands of 4; two documents of similarity 0.75 share
no band with a probability of 5e-6.

From bands to links without pairs of all with all:

1. Documents of equal shingle sets are one class, stood for by its smallest doc_id.
2. In each band bucket of several classes, the class that shares most buckets (the
   middle of a group of copies) is the bucket's leader, and the others are compared
   with it: pairs grow with members, not with their square.
3. Confirmed links give components. Buckets that lie in one component are done.
4. For the rest, links can only run between components. The classes in buckets that
   are still open are joined on the rarest part of their sets, by an exact prefix
   and position filter, which proves nearly all pairs of a group of copies that are too
   far apart without forming them; the pairs left are compared and the components
   joined. No link that the bands show is lost.

Compared means: a cheap estimate by a one-byte sketch of the signature first
(pairs under 0.55, five standard deviations below 0.75, go), then the whole sets.
Components: smallest label over links with pointer jumping, a stored table a round.

Edges: documents without words, null texts included, have an empty set and are linked
with nothing; with one to four words the whole sequence is the one shingle; rows
of one doc_id are one document with the links of all; a null doc_id is linked
with nothing, has a null component and is kept; an empty table gives no row;
other columns are not read by ``components`` and pass through ``dedup`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, documents, id_and_text, store, strings, trim

WORDS, PERCENT = 5, 75
PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
LEAST_ESTIMATE = 0.55

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = text.encode("utf-8").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = (out ^ out >> np.uint64(29)) * _MIX + h[k : k + n]
    out = (out ^ out >> np.uint64(32)) * _MIX
    return np.unique(out ^ out >> np.uint64(29))


def signature(s: np.ndarray) -> np.ndarray:
    """The minima and then the maxima under every permutation, unsigned 32 bits."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(s), 4096):
        h = s[at : at + 4096, None] * _MULTIPLIERS >> np.uint64(32)
        low, high = np.minimum(low, h.min(axis=0)), np.maximum(high, h.max(axis=0))
    return np.concatenate([low, high]).astype(np.uint32)


def bands(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket a band for each row of signatures; a band's number is part of its bucket."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, (len(signatures), BANDS)).copy()
    for k in range(ROWS):
        out = (out ^ out >> np.uint64(31)) * _MIX + parts[:, :, k]
    return ((out ^ out >> np.uint64(32)) * _MIX).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, set_key, bands, sketch), stored; set_key is null for an empty set."""

    def run(batches):
        import xxhash

        for batch in batches:
            for part in batches_of(batch):
                sets = [shingles(t) for t in strings(part.column("text"))]
                signatures = np.stack([signature(s) for s in sets])
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                flat = pa.array(bands(signatures).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), flat),
                        pa.array([row.astype(np.uint8).tobytes() for row in signatures], pa.binary()),
                    ],
                    names=["doc_id", "n", "set_key", "bands", "sketch"],
                )
        trim()

    return store(id_and_text(docs), "signatures", run, "doc_id long, n long, set_key binary, bands array<long>, sketch binary")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, n, shingles) of the documents in ids (rep), stored."""

    def run(batches):
        for batch in batches:
            for part in batches_of(batch):
                sets = [shingles(t) for t in strings(part.column("text"))]
                sizes = [len(s) for s in sets]
                ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
                flat = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), flat], names=["rep", "n", "shingles"])
        trim()

    rows = id_and_text(docs)
    # Neither side has a bound, so this is a shuffle at every size.
    wanted = rows.join(ids.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    return store(wanted, "sets", run, "rep long, n long, shingles array<long>")


def estimates(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Similarities from two columns of sketches: equal bytes, less those equal by chance."""
    x, y = (np.frombuffer(b"".join(strings(v)), np.uint8).reshape(len(v), 2 * PERMUTATIONS) for v in (a, b))
    return ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _near(batches):
    """(a, b) of the rows (a, b, sketch_a, sketch_b) that can be similar by their sketches."""
    for batch in batches:
        if batch.num_rows:
            yield batch.select(["a", "b"]).filter(pa.array(estimates(batch.column("sketch_a"), batch.column("sketch_b")) >= LEAST_ESTIMATE))


def confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose whole sets reach the similarity."""

    left, right = (sketches.select(F.col("rep").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in ("a", "b"))
    near = store(pairs.join(right, "b").join(left, "a").select("a", "b", "sketch_a", "sketch_b"), "near-pairs", _near, "a long, b long")
    left, right = (sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"set_{c}")) for c in ("a", "b"))
    both = near.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    # Row by row in the JVM, as an Arrow batch of pairs would hold thousands of whole sets.
    shared, total = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    return store(both.filter((100 + PERCENT) * shared >= PERCENT * total).select("a", "b").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ends of links (a, b): the smallest id that each can reach."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
    labels = store(both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        far = both.join(labels.select(F.col("id").alias("to"), F.col("component").alias("near")), "to").groupBy("id").agg(F.min("near").alias("near"))
        hooked = labels.join(far, "id").select("id", "component", F.least("component", "near").alias("next"))
        jump = hooked.select(F.col("id").alias("next"), F.col("next").alias("further"))
        new = store(hooked.join(jump, "next").select("id", F.col("component").alias("old"), F.least("next", "further").alias("component")), "labels")
        labels = new.select("id", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def labelled(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """members (bucket, rep, ...) with comp: the component of rep, or rep itself."""
    if comps is None:
        return members.withColumn("comp", F.col("rep"))
    return members.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def leader_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every member of a bucket with the member of the largest degree."""
    top = members.groupBy("bucket").agg(F.max(F.struct("degree", "rep")).alias("top"))
    pairs = members.join(top.select("bucket", F.col("top.rep").alias("a")), "bucket").filter("rep <> a")
    return pairs.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()


def prefix_pairs(active: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components that can reach the similarity, by prefix and position; exact.

    active: (rep, comp). Shingles are put in the order of how few of these sets hold them. Of a pair with
    n2 <= n1 that reaches p percent, the first (1 - p) n1 + 1 of the larger and (1 - 2p / (1 + p)) n2 + 1 of the smaller
    share a shingle, and at the first such there is room left for the overlap that p asks for."""

    own = sets.join(active.select("rep"), "rep", "left_semi")
    tokens = own.select("rep", F.explode("shingles").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1")
    sizes = own.join(active, "rep").select("rep", "comp", "n").distinct()
    one = Window.partitionBy("rep")  # one document's shingles
    nth = F.col("n") - F.count("*").over(one) + F.row_number().over(one.orderBy("f", "token")) - 1
    long = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    short = F.col("n") - F.ceil(F.col("n") * 2 * PERCENT / (100 + PERCENT)) + 1
    prefixes = tokens.join(shared.hint("merge"), "token").join(sizes, "rep").withColumn("i", nth).filter(F.col("i") < long)
    prefixes = store(prefixes.select("token", "rep", "comp", "n", "i", (F.col("i") < short).alias("short")), "prefixes")
    # A shingle's most frequent component is not compared with itself: of each pair one side is of another.
    held = prefixes.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token")
    held = held.agg(F.max_by("comp", "m").alias("main"), F.count("*").alias("several")).filter("several > 1").select("token", "main")
    rows = store(prefixes.join(held.hint("merge"), "token").withColumn("other", F.col("comp") != F.col("main")).drop("main"), "prefix-rows")
    asks = rows.select("token", *[F.col(c).alias(f"{c}_a") for c in ("rep", "comp", "n", "i", "other")])
    answers = rows.filter("short").select("token", "rep", "comp", "n", "i", "other")
    both = F.col("n_a") + F.col("n")
    fits = (
        (F.col("comp_a") != F.col("comp")) & ((F.col("n") < F.col("n_a")) | ((F.col("n") == F.col("n_a")) & (F.col("rep") < F.col("rep_a"))))
        & (100 * F.col("n") >= PERCENT * F.col("n_a"))
        & ((100 + PERCENT) * F.least(F.col("n_a") - F.col("i_a"), F.col("n") - F.col("i")) >= PERCENT * both)
    )
    found = [
        left.join(right.hint("merge"), (left["token"] == right["token"]) & fits).select(F.col("rep_a").alias("a"), F.col("rep").alias("b"))
        for left, right in ((asks.filter("other_a"), answers), (asks.filter("NOT other_a"), answers.filter("other")))
    ]
    return found[0].unionByName(found[1]).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    rows = signed(docs)
    usable = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = store(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    heads = usable.join(classes, "set_key").filter("doc_id = rep")
    entries = heads.select("rep", F.explode("bands").alias("bucket"))
    several = entries.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
    members = store(entries.join(several.select("bucket", "size"), "bucket").distinct(), "buckets")
    degrees = store(members.groupBy("rep").agg(F.sum("size").alias("degree")), "degrees")
    sketches = store(heads.select("rep", "sketch").join(degrees.select("rep"), "rep", "left_semi"), "sketches")
    sets = shingle_sets(docs, degrees)

    links = confirmed(leader_pairs(members.join(degrees, "rep")), sketches, sets)
    comps = components(links)
    now = labelled(members.select("bucket", "rep"), comps)
    open_buckets = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    active = store(now.join(open_buckets, "bucket", "left_semi").select("rep", "comp").distinct(), "open-classes")
    if not active.isEmpty():
        more = confirmed(prefix_pairs(active, sets), sketches, sets)
        if not more.isEmpty():
            comps = components(links.unionByName(more))
    # Several classes may have one smallest doc_id (rows of one doc_id with different texts): that is one document.
    ends = usable.join(classes, "set_key").select("doc_id", "rep")
    joined = ends.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    of_doc = labelled(ends, comps).groupBy("doc_id").agg(F.min("comp").alias("comp"), F.max("comp").alias("most"))
    if not of_doc.filter("comp <> most").isEmpty():
        every = links if active.isEmpty() else links.unionByName(more)
        comps = components(every.unionByName(joined))
        of_doc = labelled(ends, comps).groupBy("doc_id").agg(F.min("comp").alias("comp"))
    found = rows.select("doc_id", "n").join(of_doc.select("doc_id", "comp"), "doc_id", "left")
    component = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    component = F.coalesce(component, F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the one document of each component that has the smallest doc_id."""
    gone = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_gm_id")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["_gm_id"], "left_anti")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
