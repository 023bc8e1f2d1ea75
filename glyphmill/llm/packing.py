"""Best-fit packing of token sequences by the linear grouping scheme.

1. Documents longer than the capacity C are cut into pieces of C ids; the first
   piece holds the remainder. Pieces of exactly C fill a sequence each.
2. The histogram of piece lengths has at most C rows whatever the corpus, so the
   plan is made from it alone, on the driver:
   large lengths are put in descending order in groups of equal cardinality and
   rounded up to their group's largest (linear grouping); configurations of
   those few sizes are optimised by column generation (simplex with a knapsack
   for pricing) and rounded down; what is left over goes best-fit decreasing.
3. Actual pieces are substituted for the rounded ones, run by run of equal
   lengths, and the room that opens takes the small pieces best-fit. Sequences that
   still have much room are taken apart and their pieces packed best-fit again.
   The grouping is tried for several numbers of groups and small-piece bounds
   and the plan with the fewest sequences is kept.
4. A plan is a short list of runs: "sequences a .. a+n-1 hold the r-th to
   (r+n-1)-th piece of length l at offset o". Pieces are ranked within their
   length, distributed over (length, part) so that no length is one task, and
   find their run by binary search.

A stream, as ``pack_stream`` reads it from files that were written in order, is packed so that
sequences follow it: each run is laid out over STRETCHES stretches of sequences, and pieces are ranked within
their length in the order of the stream, so the k-th stretch has the pieces from the k-th
part of the stream, whatever their lengths.

Edges: a null text is the empty text (one end id); repeated rows are packed as
rows of their own; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm import tokens
from glyphmill.llm.common import documents, keep, shuffle_partitions, text_or_empty

CAPACITY = 2048
BUCKETS, STRETCHES = 256, 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACE = ", part long, nth long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """docs: (doc_id, text, part, nth), as id_and_place has them. Returns PIECES, part and nth."""
    end = np.array([tokens.END_ID], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        for part, ids in tokens.encoded(batches, vocabulary):
            rows = []
            for doc_id, at, nth, own in zip(*(part.column(c).to_pylist() for c in ("doc_id", "part", "nth")), ids, strict=True):
                own = memoryview(own + end)
                for k, (start, length) in enumerate(cut(len(own) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(own[4 * start : 4 * (start + length)]), at, nth))
            names = [c.split()[0] for c in (PIECES + PLACE).split(", ")]
            kinds = [pa.int32() if n == "piece" else pa.int64() for n in names]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.mapInArrow(run, PIECES + PLACE)


# --- the plan, from the histogram of lengths ---------------------------------


def group_sizes(large: list[tuple[int, int]], groups: int) -> list[tuple[int, int]]:
    """Linear grouping. large: (length, count) in descending order. Returns (largest length, count) of
    groups whose counts differ by one at most, in descending order."""
    total = sum(n for _, n in large)
    groups = min(groups, total)
    out, it = [], iter(large)
    length, left = next(it, (0, 0))
    for g in range(groups):
        want = total * (g + 1) // groups - total * g // groups
        top = None
        need = want
        while need:
            if not left:
                length, left = next(it)
            top = length if top is None else top
            take = min(left, need)
            left, need = left - take, need - take
        if want:
            if out and out[-1][0] == top:
                out[-1] = (top, out[-1][1] + want)
            else:
                out.append((top, want))
    return out


def price(sizes: np.ndarray, values: np.ndarray, capacity: int, unit: int) -> np.ndarray:
    """The configuration of the largest value: an unbounded knapsack over the capacity in units (sizes rounded up)."""
    weights = -(-sizes // unit)
    room = capacity // unit
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(int(weights.min()), room + 1):
        fits = np.flatnonzero(weights <= c)
        got = best[c - weights[fits]] + values[fits]
        k = int(np.argmax(got))
        best[c], last[c] = best[c - 1], -1
        if got[k] > best[c - 1] + 1e-12:
            best[c], last[c] = got[k], fits[k]
    out, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= int(weights[last[c]])
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int, unit: int = 4, rounds: int = 250) -> list[tuple[tuple[int, ...], int]]:
    """(how many of each size, how many sequences), rounded down, from the linear program over configurations."""
    size, demand = np.array(sizes), np.array(counts, float)
    m = len(size)
    basis = np.diag(np.maximum(1, capacity // size)).astype(float)
    x = demand / np.diag(basis)
    for _ in range(rounds):
        try:
            inverse = np.linalg.inv(basis)
        except np.linalg.LinAlgError:
            break
        x = inverse @ demand
        dual = np.ones(m) @ inverse
        column = price(size, dual, capacity, unit)
        if column @ dual <= 1 + 1e-7:
            break
        step = inverse @ column
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.full(m, np.inf)
        ratio[ok] = np.maximum(x[ok], 0) / step[ok]
        basis[:, int(np.argmin(ratio))] = column
    return [(tuple(int(v) for v in basis[:, j]), int(x[j] + 1e-9)) for j in range(m) if x[j] >= 1 - 1e-9]


def substitute(configs, large: list[tuple[int, int]], groups: list[tuple[int, int]]) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences of actual lengths as (lengths, how many), and the large lengths left over."""
    queues, at, it = [], 0, list(large)
    left = [[length, n] for length, n in it]
    for _, count in groups:
        queue = []
        while count:
            take = min(count, left[at][1])
            queue.append([left[at][0], take])
            count -= take
            left[at][1] -= take
            at += left[at][1] == 0
        queues.append(queue)
    out = []
    for config, times in configs:
        slots = [g for g, k in enumerate(config) for _ in range(k)]
        used = {g: config[g] for g in slots}
        for g, k in used.items():
            times = min(times, sum(n for _, n in queues[g]) // k)
        streams = []
        for g, k in used.items():
            # Each of the k places of a group takes its own stretch of the group, so that runs stay long.
            for _ in range(k):
                runs, need = [], times
                while need:
                    take = min(need, queues[g][0][1])
                    runs.append([queues[g][0][0], take])
                    queues[g][0][1] -= take
                    need -= take
                    if not queues[g][0][1]:
                        queues[g].pop(0)
                streams.append(runs)
        while times > 0 and streams:
            n = min(runs[0][1] for runs in streams)
            out.append((tuple(runs[0][0] for runs in streams), n))
            times -= n
            for runs in streams:
                runs[0][1] -= n
                if not runs[0][1]:
                    runs.pop(0)
    rest: dict[int, int] = defaultdict(int)
    for queue in queues:
        for length, n in queue:
            rest[length] += n
    return out, {k: v for k, v in rest.items() if v}


def best_fit(sequences: list[tuple[tuple[int, ...], int]], rest: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of the rest into the room of the sequences and into new ones, run by run."""
    by_room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append([lengths, n])

    for lengths, n in sequences:
        put(lengths, n)
    for length in sorted(rest, reverse=True):
        need = rest[length]
        while need:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                fit = capacity // length
                if need >= fit:
                    put((length,) * fit, need // fit)
                if need % fit:
                    put((length,) * (need % fit), 1)
                break
            room = rooms[k]
            lengths, n = by_room[room][-1]
            # The same sequence may take several of this length; then its room is used at once.
            times = min(room // length, max(1, need // n) if need >= n else 1)
            take = min(n, need // times)
            if take == n:
                by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(k)
            else:
                by_room[room][-1][1] -= take
            put(lengths + (length,) * times, take)
            need -= take * times
    return [(lengths, n) for entries in by_room.values() for lengths, n in entries]


def repack(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes sequences with much room apart and packs their pieces best-fit, while that saves sequences."""
    best = plan
    for most in (64, 16, 4, 1, 0):
        keep = [(lengths, n) for lengths, n in plan if capacity - sum(lengths) <= most]
        rest: dict[int, int] = defaultdict(int)
        for lengths, n in plan:
            if capacity - sum(lengths) > most:
                for length in lengths:
                    rest[length] += n
        again = keep + best_fit([], rest, capacity)
        if sum(n for _, n in again) < sum(n for _, n in best):
            best = again
    return best


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) for all pieces; deterministic, bounded by the capacity."""
    full = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    lengths = {k: v for k, v in histogram.items() if 0 < k < capacity and v}
    if not lengths:
        return full
    lower = -(-sum(k * v for k, v in lengths.items()) // capacity)
    best = best_fit([], lengths, capacity) if len(lengths) < 3 else None
    for parts, groups in ((3, 64), (5, 64), (8, 48), (2, 24)) if best is None else ():
        bound = capacity // parts
        large = sorted(((k, v) for k, v in lengths.items() if k > bound), reverse=True)
        small = {k: v for k, v in lengths.items() if k <= bound}
        if not large:
            plan = best_fit([], small, capacity)
        else:
            grouped = group_sizes(large, groups)
            configs = configurations([k for k, _ in grouped], [v for _, v in grouped], capacity)
            done, rest = substitute(configs, large, grouped)
            for k, v in small.items():
                rest[k] = rest.get(k, 0) + v
            plan = repack(best_fit(done, rest, capacity), capacity)
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
        if sum(n for _, n in best) <= lower * 1.0005 + 1:
            break
    return full + best


def runs_of(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset), ascending ranks: where pieces of that length go."""
    taken: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            out[length].append((taken[length], first, offset))
            taken[length] += n
            offset += length
        first += n
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


# --- the distributed part ----------------------------------------------------


def id_and_place(docs: DataFrame, stream: bool) -> DataFrame:
    """(doc_id, text, part, nth): nth is the order within a part. Of a stream, the files (by their numbers) and the rows in them;
    else hash buckets, in which documents are ordered by doc_id."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    if not stream:
        buckets = max(BUCKETS, 4 * shuffle_partitions(docs.sparkSession))  # so that the pieces of one length are dealt to as many tasks as there are
        return texts.withColumn("part", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(buckets))).withColumn("nth", F.col("doc_id"))
    try:
        file = docs.metadataColumn("_metadata")
        part = F.coalesce(F.regexp_extract(file["file_name"], r"^part-(\d+)", 1).try_cast("long"), F.pmod(F.xxhash64(file["file_path"]), F.lit(BUCKETS)))
        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"), part.alias("part"), file["row_index"].cast("long").alias("nth"))
    except AnalysisException:  # rows of no file are in the order of their partitions
        return texts.withColumn("part", F.spark_partition_id().cast("long")).withColumn("nth", F.monotonically_increasing_id())


def ranked(cut_pieces: DataFrame) -> DataFrame:
    """Adds rank: 0, 1, ... within each length, in the order of parts, counted over (length, part) and then over parts."""
    counts = cut_pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("nth", "doc_id", "piece", "start", "ids_crc32"))
    return (
        cut_pieces.withColumn("own", own)
        .join(before, ["length", "part"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    )


def spread(plan: list[tuple[tuple[int, ...], int]], stretches: int = STRETCHES) -> list[tuple[tuple[int, ...], int]]:
    """The same sequences, each kind dealt evenly over the stretches."""
    out = []
    phases = [(k * 0.6180339887) % 1 for k in range(len(plan))]  # so that kinds of few sequences don't meet in one stretch
    for b in range(stretches):
        for (lengths, n), phase in zip(plan, phases, strict=True):
            own = int(n * (b + 1) / stretches + phase) - int(n * b / stretches + phase)
            if own:
                out.append((lengths, own))
    return out


def _packed(docs: DataFrame, vocabulary: str, capacity: int, stream: bool) -> DataFrame:
    cut_pieces = keep(pieces(id_and_place(docs, stream), vocabulary, capacity))
    # At most `capacity` rows, whatever the corpus.
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pack_histogram(histogram, capacity)
    runs = runs_of(spread(plan) if stream else plan)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                own = runs[int(length[at[0]])]
                k = np.searchsorted(own[:, 0], rank[at], side="right") - 1
                sequence[at] = own[k, 1] + rank[at] - own[k, 0]
                offset[at] = own[k, 2]
            keep_ = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays(
                [*keep_.columns, pa.array(sequence), pa.array(offset)], names=[*keep_.schema.names, "sequence_id", "offset"]
            )

    return ranked(cut_pieces).mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    return _packed(docs, vocabulary, capacity, stream=False)


def pack_stream(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The same sequences in number; their ids follow the stream that docs were written as."""
    return _packed(docs, vocabulary, capacity, stream=True)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokens.vocabulary())
