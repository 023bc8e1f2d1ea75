"""Ranked lexical search by Block-Max WAND over an index of segments.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.

* Index: the documents of a task go to segments of about SEGMENT_BYTES of text, one stored row each, with documents in ascending
  order of doc_id. A term's postings (document, occurrences) lie in blocks of BLOCK postings, packed as
  gaps and counts of one, two or four bytes, the least that the block needs. A block's last document and its greatest impact,
  the part of a score that depends on the document, stand apart, so they are read without unpacking it.
* Search: one pass sums the documents of each query term over segments, which gives the weights. A second adds up, per segment, the
  RARE heaviest terms of an item; the k-th largest of such part sums over all segments is a score
  that k documents reach at least, so every segment starts from it. The third is Block-Max WAND: the pivot is the
  first document at which the terms' greatest impacts could reach what is needed; block pointers then move without unpacking, and if the
  greatest impacts of the blocks there don't reach it, all cursors skip to where the first of these blocks ends. Only
  where they do, blocks are unpacked and the document is scored. The k best of each segment meet in a window.

Scale: documents are not shuffled; a segment is bounded, and so is what an item gets from it. Queries go in
blocks of about QUERY_BYTES to all segments, one job each; only a block, its terms' counts and its items' thresholds are in the driver.
Counting the terms of all documents is a pass of its own before, as impacts depend on the mean length.

Edges: null and empty texts have no terms and are no documents of the count; an item without terms, or none that occurs, has no row; equal
items (id and text) are one; rows that repeat a doc_id are documents of their own; a null doc_id sorts first and stays
null; empty tables give no row; other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from dataclasses import dataclass
from operator import attrgetter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, documents, id_and_text, store, strings, text_or_empty, trim

BLOCK, SEGMENT_BYTES, QUERY_BYTES, RARE, BEST = 128, 16 << 20, 4 << 20, 8, 10
_NO_ID, _END = -(1 << 63), 1 << 62
_MOST_UNPACKED = 2_000_000
_DOC = attrgetter("doc")

# Fixed values of the contract: separators are ASCII without letters and digits.
_TERM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(texts):
    """(terms of all texts as an Arrow array of bytes, the text of each, the number of terms of each text)"""
    import pyarrow as pa

    texts = texts.cast(pa.string()) if pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    first, ends = int(ends[0]), (ends - ends[0]).astype(np.int64)
    buffer = np.frombuffer(data.slice(first, int(ends[-1])).to_pybytes().translate(_LOWER), np.uint8) if ends[-1] else np.zeros(0, np.uint8)
    inside = _TERM[buffer]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # A text's first character begins a term even if the text before ends in one.
    opens = ends[:-1][ends[:-1] < len(buffer)]
    begins[opens] = inside[opens]
    starts = np.flatnonzero(begins)
    before = np.concatenate([[0], np.cumsum(inside)])
    bounds = np.append(before[starts], before[-1]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(buffer[inside].tobytes())])
    n = np.diff(np.searchsorted(starts, ends))
    return flat, np.repeat(np.arange(len(texts)), n), n


@dataclass(frozen=True)
class Stats:
    """Documents with a term, and all their terms with repeats."""

    documents: int
    terms: int

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents of n terms."""
        if not self.terms:
            return np.full(len(n), 10, np.int64)
        if 90 * int(n.max(initial=0)) * self.documents < 1 << 63:
            return 10 + 90 * n.astype(np.int64) * self.documents // self.terms
        return np.array([10 + 90 * x * self.documents // self.terms for x in n.tolist()], np.int64)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def corpus_stats(docs: DataFrame) -> Stats:
    def run(batches):
        import pyarrow as pa

        n = terms = 0
        for batch in batches:
            for part in batches_of(batch, 2 << 20):
                _, _, sizes = terms_of(part.column("text"))
                n, terms = n + int((sizes > 0).sum()), terms + int(sizes.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "terms": [terms]})

    row = docs.select(text_or_empty(docs).alias("text")).mapInArrow(run, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return Stats(row[0] or 0, row[1] or 0)


def _widths(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4)).astype(np.uint8)


#: Columns of a segment. By document: id and length m; by term: its bytes, documents and first block; by block: last document, greatest impact, place and widths.
COLUMNS = {
    "doc_ids": np.int64, "m": np.int64, "term_ends": np.int32, "terms": np.uint8, "df": np.int32, "first_block": np.int32,
    "last": np.int32, "impact": np.int32, "place": np.int64, "widths": np.uint8, "postings": np.uint8,
}
INDEX = ", ".join(f"{c} binary" for c in COLUMNS)


def segment(doc_ids: np.ndarray, texts, stats: Stats) -> dict[str, np.ndarray]:
    """The columns of a segment of documents in ascending order of ids."""
    flat, of, n = terms_of(texts)
    coded = flat.dictionary_encode()
    distinct, size = coded.dictionary, len(doc_ids)
    m = stats.lengths(n)
    key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * size + of, return_counts=True)
    term, doc = key // max(size, 1), key % max(size, 1)
    df = np.bincount(term, minlength=len(distinct))
    at = np.arange(len(key)) - np.repeat(np.cumsum(df) - df, df)
    opens = np.flatnonzero(at % BLOCK == 0)
    block = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(key))))
    before = np.concatenate([[-1], doc[:-1]])
    before[at == 0] = -1
    gap = doc - before - 1
    most = np.maximum.reduceat if len(opens) else lambda x, _: x
    wide_gap, wide_tf = _widths(most(gap, opens)), _widths(most(tf, opens))
    count = np.diff(np.append(opens, len(key)))
    sizes = count * (wide_gap.astype(np.int64) + wide_tf)
    place = np.cumsum(sizes) - sizes
    packed = np.zeros(int(sizes.sum()), np.uint8)
    nth, gap_width, tf_width = at % BLOCK, wide_gap[block], wide_tf[block]
    for values, width, start in ((gap, gap_width, place[block] + nth * gap_width), (tf, tf_width, place[block] + count[block] * gap_width + nth * tf_width)):
        for k in range(4):
            own = np.flatnonzero(width > k)
            packed[start[own] + k] = values[own] >> 8 * k & 255
    _, ends, data = distinct.buffers()
    out = {
        "doc_ids": doc_ids, "m": m, "term_ends": np.frombuffer(ends, np.int32)[: len(distinct) + 1] if len(distinct) else np.zeros(1, np.int32),
        "df": df, "first_block": np.concatenate([[0], np.cumsum(-(-df // BLOCK))]), "last": doc[np.append(opens[1:], len(key)) - 1] if len(key) else doc,
        "impact": most(impacts(tf, m[doc]), opens), "place": place, "widths": wide_gap << 4 | wide_tf, "postings": packed,
    }
    out["terms"] = np.frombuffer(data, np.uint8)[: out["term_ends"][-1]] if len(distinct) else np.zeros(0, np.uint8)
    return {c: out[c].astype(kind) for c, kind in COLUMNS.items()}


def build(docs: DataFrame, stats: Stats, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index of docs."""

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def done():
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = rows.column("doc_id").combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            texts = rows.column("text").take(pa.array(order)).combine_chunks()
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            own = segment(ids[order], texts, stats)
            return pa.RecordBatch.from_arrays([pa.array([own[c].tobytes()], pa.binary()) for c in COLUMNS], names=list(COLUMNS))

        for batch in batches:
            for part in batches_of(batch, min(2 << 20, segment_bytes)):
                held.append(part)
                size += part.nbytes
                if size >= segment_bytes:
                    yield done()
                    size = 0
        if held:
            yield done()
        trim()

    return store(id_and_text(docs), "lexical-index", run, INDEX)


class Segment:
    """A segment as it is searched; unpacked blocks are kept for the next items."""

    def __init__(self, row, wanted: list[bytes]):
        import pyarrow as pa
        import pyarrow.compute as pc

        self._columns = {c: np.frombuffer(row.column(c)[0].as_buffer(), COLUMNS[c]) for c in row.schema.names}
        ends = self._columns["term_ends"]
        terms = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(self._columns["terms"])])
        found = pc.index_in(pa.array(wanted, pa.binary()), value_set=terms)
        #: Numbers of wanted terms -> terms of the segment.
        self.number = {k: n for k, n in enumerate(found.to_pylist()) if n is not None}
        self._kept, self._size, self._lists = {}, 0, {}
        self.m = self._columns["m"].tolist() if "m" in self._columns else None

    def df(self, number: int) -> int:
        return int(self._columns["df"][number])

    def blocks(self, number: int) -> tuple[list[int], list[int], int]:
        """The last documents and greatest impacts of a term's blocks, and the first block."""
        if number not in self._lists:
            a, b = self._columns["first_block"][number : number + 2].tolist()
            self._lists[number] = self._columns["last"][a:b].tolist(), self._columns["impact"][a:b].tolist(), a
        return self._lists[number]

    def _arrays(self, number: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        c, (lasts, _, first) = self._columns, self.blocks(number)
        size = min(BLOCK, self.df(number) - k * BLOCK)
        place, widths = int(c["place"][first + k]), int(c["widths"][first + k])
        a, b = widths >> 4, widths & 15
        gaps = np.frombuffer(c["postings"], f"<u{a}", size, place).astype(np.int64)
        docs = np.cumsum(gaps + 1) + (lasts[k - 1] if k else -1)
        return docs, np.frombuffer(c["postings"], f"<u{b}", size, place + size * a).astype(np.int64)

    def block(self, number: int, k: int) -> tuple[list[int], list[int]]:
        """Documents and occurrences of a term's k-th block."""
        known = self._kept.get((number, k))
        if known is None:
            docs, tf = self._arrays(number, k)
            if self._size > _MOST_UNPACKED:
                self._kept.clear()
                self._size = 0
            known = self._kept[number, k] = docs.tolist(), tf.tolist()
            self._size += len(docs)
        return known

    def part_sums(self, terms: list[tuple[int, int]], best: int) -> list[int]:
        """The best sums of some terms (number, weight) that documents have."""
        docs, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for number, weight in terms:
            for k in range(len(self.blocks(number)[0])):
                own, tf = self._arrays(number, k)
                docs.append(own)
                sums.append(weight * impacts(tf, self._columns["m"][own]))
        own, at = np.unique(np.concatenate(docs), return_inverse=True)
        every = np.bincount(at, np.concatenate(sums), len(own)).astype(np.int64)
        return np.sort(every)[::-1][:best].tolist()

    def doc_id(self, doc: int) -> int | None:
        own = int(self._columns["doc_ids"][doc])
        return None if own == _NO_ID else own


class Cursor:
    """A term's place in a segment. It is at doc, a posting, or, if loose, somewhere from doc on, with nothing unpacked yet."""

    __slots__ = ("_at", "_block", "_docs", "_number", "_segment", "_tf", "_unpacked", "bound", "doc", "impact", "last", "loose", "weight")

    def __init__(self, segment: Segment, number: int, weight: int):
        self._segment, self._number, self.weight = segment, number, weight
        self.last, self.impact, _ = segment.blocks(number)
        self.bound = weight * max(self.impact)
        self._block, self._unpacked, self._at = 0, -1, 0
        self.doc, self.loose = 0, True

    def look(self, doc: int) -> int:
        """Moves the block pointer to the first block that ends at doc or later: that block's number, or the number of blocks."""
        if self._block < len(self.last) and self.last[self._block] < doc:
            self._block = bisect_left(self.last, doc, self._block + 1)
        return self._block

    def skip(self, doc: int) -> None:
        """To doc or later, without unpacking."""
        self.doc, self.loose = (_END, False) if self.look(doc) == len(self.last) else (doc, True)

    def move(self, doc: int) -> None:
        """To the first posting at doc or later."""
        k, self.loose = self.look(doc), False
        if k == len(self.last):
            self.doc = _END
            return
        if k != self._unpacked:
            self._docs, self._tf = self._segment.block(self._number, k)
            self._unpacked, self._at = k, 0
        self._at = bisect_left(self._docs, doc, self._at)
        self.doc = self._docs[self._at]

    def score(self, m: int) -> int:
        tf = self._tf[self._at]
        return self.weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def best_of_segment(segment: Segment, terms: list[tuple[int, int]], least: int, best: int) -> list[tuple[int, int]]:
    """The best documents (score, document) of a segment for terms (number, weight) of positive weights; scores are at least least.
    Of equal scores the first documents stay."""
    cursors = [Cursor(segment, number, weight) for number, weight in terms]
    heap: list[tuple[int, int]] = []
    while True:
        cursors = sorted((c for c in cursors if c.doc != _END), key=_DOC)
        reach = 0
        for at, cursor in enumerate(cursors):
            reach += cursor.bound
            if reach >= least:
                break
        else:
            return [(score, -doc) for score, doc in heap]
        pivot = cursor.doc
        while at + 1 < len(cursors) and cursors[at + 1].doc == pivot:
            at += 1
        here = cursors[: at + 1]
        # Blocks are looked at, not unpacked: what could the documents here score, and how far does that hold?
        reach, until = 0, cursors[at + 1].doc if at + 1 < len(cursors) else _END
        for c in here:
            k = c.look(pivot)
            if k < len(c.last):
                reach += c.weight * c.impact[k]
                until = min(until, c.last[k] + 1)
        if reach < least:
            for c in here:
                c.skip(until)
            continue
        behind = [c for c in here if c.loose or c.doc < pivot]
        if behind:
            for c in behind:
                c.move(pivot)
            continue
        m = segment.m[pivot]
        score = sum(c.score(m) for c in here)
        if score >= least:
            # Documents come in ascending order, so an equal score doesn't displace an earlier one.
            heapq.heappush(heap, (score, -pivot))
            if len(heap) > best:
                heapq.heappop(heap)
            if len(heap) == best:
                least = max(least, heap[0][0] + 1)
        for c in here:
            c.move(pivot + 1)


def _best(rows: DataFrame, best: int) -> DataFrame:
    """The best rows of each item, equal scores by ascending doc_id; adds rank. Each task keeps no more of its own before rows are shuffled."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def _items(batch: list) -> list[tuple[int | None, list[bytes]]]:
    """The items of a block of queries with their distinct terms."""
    import pyarrow as pa

    flat, of, _ = terms_of(pa.array([r["text"] or "" for r in batch], pa.string()))
    own: list[dict[bytes, None]] = [{} for _ in batch]
    for term, k in zip(strings(flat), of.tolist(), strict=True):
        own[k][term] = None
    return [(r["item_id"], list(terms)) for r, terms in zip(batch, own, strict=True)]


def _search_block(index: DataFrame, stats: Stats, batch: list, best: int) -> DataFrame:
    spark = index.sparkSession
    items = _items(batch)
    names = sorted({t for _, terms in items for t in terms})
    shared_names = spark.sparkContext.broadcast(names)

    def frequencies(batches):
        import pyarrow as pa

        for rows in batches:
            for k in range(rows.num_rows):
                own = Segment(rows.slice(k, 1), shared_names.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(own.number), pa.int64()), pa.array([own.df(n) for n in own.number.values()], pa.int64())], names=["term", "df"])

    found = index.select("term_ends", "terms", "df").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weights = {r["term"]: stats.weight(r["df"]) for r in found}
    number = {name: k for k, name in enumerate(names)}
    # A term in every document may weigh nothing, so it adds nothing.
    plans = [sorted(((weights[k], k) for k in map(number.__getitem__, terms) if weights.get(k)), reverse=True) for _, terms in items]
    shared = spark.sparkContext.broadcast(plans)

    def starts(batches):
        import pyarrow as pa

        for rows in batches:
            for k in range(rows.num_rows):
                own = Segment(rows.slice(k, 1), shared_names.value)
                out = []
                for item, plan in enumerate(shared.value):
                    terms = [(own.number[t], w) for w, t in plan[:RARE] if t in own.number]
                    out += [(item, s) for s in own.part_sums(terms, best)] if terms else []
                columns = list(zip(*out, strict=True)) or [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "score"])

    sums = index.mapInArrow(starts, "item long, score long").withColumn("doc_id", F.lit(0))
    reached = {r["item"]: r["score"] for r in _best(sums, best).filter(F.col("rank") == best).select("item", "score").collect()}
    least = spark.sparkContext.broadcast([max(1, reached.get(k, 1)) for k in range(len(items))])

    def search(batches):
        import pyarrow as pa

        for rows in batches:
            for k in range(rows.num_rows):
                own = Segment(rows.slice(k, 1), shared_names.value)
                out = []
                for item, plan in enumerate(shared.value):
                    terms = [(own.number[t], w) for w, t in plan if t in own.number]
                    out += [(item, own.doc_id(doc), score) for score, doc in best_of_segment(own, terms, least.value[item], best)]
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])
        trim()

    hits = store(_best(index.mapInArrow(search, "item long, doc_id long, score long"), best), "lexical-hits")
    ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item long, item_id long")
    return hits.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, stats: Stats, queries: DataFrame, best: int = BEST, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """queries (item_id, text): (item_id, rank, doc_id, score), the best documents of each item."""
    asked = queries.select(queries["item_id"].cast("long").alias("item_id"), text_or_empty(queries).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // query_bytes)
    out = None
    for k in range(blocks):
        batch = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        if batch:
            own = _search_block(index, stats, batch, best)
            out = own if out is None else out.unionByName(own)
    return queries.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def ranked(docs: DataFrame, queries: DataFrame, best: int = BEST, **options) -> DataFrame:
    """The best documents of each query; options are those of ``build``."""
    stats = corpus_stats(docs)
    return search(build(docs, stats, **options), stats, queries, best)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER, _LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = rf"unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LETTERS}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
ORACLE = f"""
WITH asked AS (
  SELECT DISTINCT item_id, {_FOUND} AS term FROM benchmark
), numbered AS (
  SELECT row_number() OVER () AS nth, doc_id, text FROM documents
), found AS (
  SELECT nth, doc_id, {_FOUND} AS term FROM numbered
), lengths AS (
  SELECT nth, CAST(count(*) AS BIGINT) AS n FROM found GROUP BY nth
), stats AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), postings AS (
  SELECT nth, any_value(doc_id) AS doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM found WHERE term IN (SELECT term FROM asked) GROUP BY nth, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats
), scores AS (
  SELECT item_id, nth, any_value(doc_id) AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (nth), stats GROUP BY item_id, nth
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= {BEST}
"""
