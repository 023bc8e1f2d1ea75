"""Interpolated modified Kneser-Ney over an open vocabulary of words, by joins of n-grams.

Words are runs of letters and digits as they stand; each other mark, and each character of
scripts without spaces, is one of its own. A word is a 64-bit hash, an n-gram the chained
xxhash64 of its words, so nothing bounds the vocabulary: the table grows with the text that trains.
A word that was not seen has the uniform share of the lowest order, 1 / (words + 1).

The log probability of a text is a sum over its n-grams of all orders,

    log p(w | a b) = base + F1(w) + G1(b) + F2(b w) + G2(a b) + F3(a b w)

where G is the log of a context's weight for the lower order, F what an n-gram's own
probability adds to its suffix's, and either is 0 if not seen: back-off without branches.
One table (hash, value) thus has the whole model, of all text that trains. Counts lie in shards of the last two words of three, which say how many
words are before a pair; sums of pairs by their first and second words are joined to them, and what they give goes on to shards of the first two words, where
a context's followers lie together, and stay. So no shard has all of a frequent word. Texts send the n-grams that slices of
them hold to shards of that table, by hash, and get their sums back by text key.

Scale: shards grow in number with what trains, and not in size, but for a pair of words itself, whose neighbours one task holds. The table is made in
TRAIN_PASSES parts by the hash of contexts; texts meet a part, in BATCHES passes (MANY if the filter is full), and it is deleted before the next is made, so
that a part and a pass are on disk at a time, besides the counts. Counts have a row's words once and places in them; hashes go as differences.
A slice sends a row to each shard, with its sums coming back by the slice's number, and its texts' keys once.
A shard is met by a task for every GROUP_BYTES of text. N-grams that a filter of a part's hashes, of FILTER_BITS
bits whatever the part's size, shows not to be there stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, discard, file_system, shuffle_partitions, store, strings, trim

ORDER, SLICE, SHARD_BYTES, TABLE_BITS = 3, 2 << 20, 8 << 20, 4
#: Text that meets a shard in one task; bits of the filter's size; bytes of the table in a shard.
GROUP_BYTES, FILTER_BITS, TABLE_SHARD = 32 << 20, 25, 32 << 20
#: Characters that are hashed at a time.
CACHED = 256 << 10
#: Passes of counting; parts of the table, each of which texts meet before the next is made; passes of texts a part, and those if its filter
#: knows more than half of all prefixes (twice as many with the first part, which has the single words).
COUNT_PASSES, TRAIN_PASSES, BATCHES, MANY = 2, 4, 2, 4
#: Bits for the place in a slice; a hash's others order it.
_PLACE = 22
_SEED = np.uint64(42)
#: Upper bits that runs of three words share with their contexts, so that they lie in the same shard.
_SHARED = 16
_TOP = np.uint64(((1 << _SHARED) - 1) << 64 - _SHARED)
_ALONE = "฀-໿က-႟ក-៿⺀-鿿豈-﫿\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W{_ALONE}]+|[{_ALONE}]|[^\w\s]")
START, END = 1, 2
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    """x, which is used up."""
    upper = x << np.uint64(by)
    x >>= np.uint64(64 - by)
    upper |= x
    return upper


def chained(seed: np.ndarray | np.uint64, words: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one more long, after seed."""
    h = _rotated(words * _P2, 31)
    h *= _P1
    h ^= seed + (_P5 + np.uint64(8))
    h = _rotated(h, 27)
    h *= _P1
    h += _P4
    for by, factor in ((33, _P2), (29, _P3)):
        h ^= h >> np.uint64(by)
        h *= factor
    h ^= h >> np.uint64(32)
    return h


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point, what WORD makes of it (0: between words, 1: in a run, 2: a word of its own), and a hash, 0 between words."""
    every, kinds = "".join(map(chr, range(0x110000))), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((1, rf"[^\W{_ALONE}]+"), (2, rf"[{_ALONE}]+|[^\w\s]+")):
        for m in re.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds, np.where(kinds > 0, chained(np.uint64(3), np.arange(0x110000, dtype=np.uint64)), np.uint64(0))


def _places(n: int) -> np.ndarray:
    """An odd factor for each of the first n places of a word."""
    return chained(np.uint64(4), np.arange(n, dtype=np.uint64)) | np.uint64(1)


_TABLES: dict[str, np.ndarray] = {}


def _word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of a text's words, where each begins): sums of its code points' hashes, each times the factor of its place, mixed."""
    if not _TABLES:
        _TABLES["kinds"], _TABLES["letters"] = _kinds()
        _TABLES["places"] = _places(4096)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _TABLES["kinds"][codes]
    begins = kinds == 1
    begins[1:] &= ~begins[:-1].copy()
    begins |= kinds == 2
    at = np.flatnonzero(begins)
    if not len(at):
        return np.empty(0, np.uint64), at
    size = np.diff(np.append(at, len(codes)))
    place = np.arange(at[0], len(codes), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
    most = int(size.max())
    factors = _TABLES["places"] if most <= len(_TABLES["places"]) else _places(most)
    sums = np.add.reduceat(_TABLES["letters"][codes[at[0] :]] * factors[place], at - at[0])
    return chained(np.uint64(5), sums), at


class _Hashes:
    """word -> hash."""

    def __getitem__(self, word: str) -> int:
        return int(_word_hashes(word)[0][0])


_HASHES = _Hashes()


def _slice(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, each with its edges if it has any, which text each is of)."""
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    # By as many texts at a time as the processor's cache holds.
    for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(np.cumsum(lengths) // CACHED)) + 1) if texts else ():
        h, at = _word_hashes(" ".join(texts[own[0] : own[-1] + 1]))
        hashes.append(h)
        counts.append(np.diff(np.searchsorted(at, np.cumsum([0, *lengths[own]]))))
    h, count = np.concatenate(hashes), np.concatenate(counts)
    sizes = np.where(count > 0, count + ORDER, 0)
    ends = np.cumsum(sizes)
    words = np.full(int(sizes.sum()), START, np.uint64)
    words[np.arange(len(h)) + np.repeat(ends - sizes + ORDER - 1 - (np.cumsum(count) - count), count)] = h
    words[ends[count > 0] - 1] = END
    return words, np.repeat(np.arange(len(texts)), sizes)


def _ordered(h: np.ndarray) -> np.ndarray:
    """argsort by the upper bits of hashes (all equal hashes come together, but for rare ties), several times as fast."""
    if len(h) >> _PLACE:
        return np.argsort(h)
    low = np.uint64((1 << _PLACE) - 1)
    return (np.sort(h & ~low | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)


def length(texts: DataFrame) -> int:
    """Characters of all texts."""
    return texts.agg(F.sum(F.length("text"))).first()[0] or 0


def shard_bits(texts: DataFrame) -> int:
    """Bits of hashes that deal what trains to shards of about SHARD_BYTES of text."""
    return max(3, int(length(texts) // SHARD_BYTES).bit_length())


def _shards(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _part(hashes: np.ndarray, of: int) -> np.ndarray:
    """The part of the table that has a context, the runs of words that begin with it, and the pair of words that it is. Low bits, as high ones give the shard."""
    return hashes % np.uint64(of)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Where a new group of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


COUNTS = ["a", "b", "pairs", "w", "size", "n", "words"]


def _bytes(values: np.ndarray) -> bytes:
    """Numbers by their bytes: all lowest ones, then all next ones, as far as any has them."""
    most = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :most].T).tobytes()


def _numbers(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(packed, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.reshape(-1).view(np.int64)


def _deltas(hashes: np.ndarray, shard: int, bits: int) -> bytes:
    """Ascending hashes of a shard by their differences."""
    return _bytes(np.diff(hashes, prepend=np.uint64(shard << 64 - bits)))


def _hashes(packed: bytes, n: int, shard: int, bits: int) -> np.ndarray:
    return np.cumsum(_numbers(packed, n).view(np.uint64)) + np.uint64(shard << 64 - bits)


def _key(context: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hash of a run of three words in the table: the upper bits of its context's, and the others of its own."""
    return context & _TOP | chained(context, words) & ~_TOP


def _packed_counts(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[bytes, ...]:
    """COUNTS of runs of three words, ordered by b, w and a: each b once with its number of pairs (b, w), each pair once with
    its number of a; a and w as places in the row's own words, frequent ones first."""
    pair = _groups(b, w)
    own = _groups(b[pair])
    words, places, times = np.unique(np.concatenate([a, w[pair]]), return_inverse=True, return_counts=True)
    order = np.argsort(-times)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    places = rank[places]
    pairs, size = np.diff(np.append(own, len(pair))), np.diff(np.append(pair, len(b)))
    return _bytes(places[: len(a)]), b[pair][own].tobytes(), pairs.astype(np.uint32).tobytes(), _bytes(places[len(a) :]), size.astype(np.uint32).tobytes(), _bytes(n), words[order].tobytes()


def _pairs_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(b, w, the number of words before) of each pair of a row of counts."""
    held = {c: row.column(c)[0].as_buffer() for c in ("b", "pairs", "w", "size", "words")}
    size = np.frombuffer(held["size"], np.uint32)
    b = np.repeat(np.frombuffer(held["b"], np.uint64), np.frombuffer(held["pairs"], np.uint32))
    return b, np.frombuffer(held["words"], np.uint64)[_numbers(held["w"], len(size))], size


def _read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The packed counts (a, b, w, n) of a row."""
    b, w, size = _pairs_of(row)
    m = int(size.sum())
    words = np.frombuffer(row.column("words")[0].as_buffer(), np.uint64)
    a, n = (_numbers(row.column(c)[0].as_buffer(), m) for c in ("a", "n"))
    return words[a], np.repeat(b, size), np.repeat(w, size), n


def counted(texts: DataFrame, bits: int) -> DataFrame:
    """(shard, COUNTS), stored: a row a shard of the last two words, with its runs of three words and how often each occurs, packed and
    ordered by b, w and a. Each slice sums its own first. Texts are read for one part of the shards after the other."""
    done = None
    for part in range(COUNT_PASSES):
        counts = _counted(texts, bits, part)
        done = counts if done is None else done.unionByName(counts)
    return done


def _counted(texts: DataFrame, bits: int, part: int) -> DataFrame:
    schema = "shard long, " + ", ".join(f"{c} binary" for c in COUNTS)

    def packed(rows: list[tuple]):
        import pyarrow as pa

        out = [(shard, *_packed_counts(*held)) for shard, *held in rows]
        columns = list(zip(*out, strict=True)) or [[]] * (1 + len(COUNTS))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["shard", *COUNTS])

    def plain(rows: list[tuple]):
        """Of a slice, whose shards have few of its words each: a pair is packed once for all its a."""
        import pyarrow as pa

        out = []
        for shard, a, b, w, n in rows:
            pair = _groups(b, w)
            size = np.diff(np.append(pair, len(b)))
            out.append((shard, a.tobytes(), b[pair].tobytes(), w[pair].tobytes(), _bytes(size), _bytes(n)))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["shard", *sent])

    def summed(a, b, w, n):
        order = np.lexsort((a, w, b))
        a, b, w, n = a[order], b[order], w[order], n[order]
        first = _groups(b, w, a)
        return a[first], b[first], w[first], _sum(n, first)

    sent = ["a", "b", "w", "size", "n"]

    def send(batches):
        for batch in batches:
            for texts in batches_of(batch, SLICE):
                s, of = _slice(strings(texts.column("text")))
                at = np.flatnonzero(of[2:] == of[:-2]) if len(s) else np.empty(0, np.int64)
                pair = chained(chained(_SEED, s[at + 1]), s[at + 2])
                own = _shards(pair, bits) % COUNT_PASSES == part
                at, pair = at[own], pair[own]
                # By shards, pairs, and words before; what lies apart for a tie is sent twice, and summed in the shard.
                order = _ordered(pair >> np.uint64(40) << np.uint64(40) | s[at] >> np.uint64(24))
                at, pair = at[order], pair[order]
                a, b, w = s[at], s[at + 1], s[at + 2]
                first = _groups(b, w, a)
                n = np.diff(np.append(first, len(a)))
                rows = a[first], b[first], w[first], n
                ends = np.searchsorted(_shards(pair[first], bits), np.arange((1 << bits) + 1))
                yield plain([(k, *(x[i:j] for x in rows)) for k, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if i < j])
        trim()

    def merge(rows):
        held = []
        for k in range(rows.num_rows):
            a, b, w, size, n = (rows.column(c)[k].as_buffer() for c in sent)
            a, b, w = (np.frombuffer(x, np.uint64) for x in (a, b, w))
            size = _numbers(size, len(b))
            held.append((a, np.repeat(b, size), np.repeat(w, size), _numbers(n, len(a))))
        return packed([(rows.column("shard")[0].as_py(), *summed(*map(np.concatenate, zip(*held, strict=True))))])

    dealt = texts.select("text").mapInArrow(send, "shard long, " + ", ".join(f"{c} binary" for c in sent))
    return by_shard(dealt, merge, schema, name="trigrams")


def by_shard(rows: DataFrame, merge, schema: str, key: str = "shard", name: str | None = None) -> DataFrame:
    """merge(all rows of a shard) -> a batch, for every shard; stored under a name if that is given."""

    def run(batches):
        import pyarrow as pa

        held = []

        def done():
            out = merge(pa.Table.from_batches(held))
            held.clear()
            return out

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                if held and held[0].column(key)[0] != row.column(key)[0]:
                    yield done()
                held.append(row)
        if held:
            yield done()
        trim()

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), key).sortWithinPartitions(key)
    return store(dealt, name, run, schema, "zstd") if name else dealt.mapInArrow(run, schema)


def _of_counts(counts: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """What the counts of shards say of lower orders: (shard, w, n): in how many pairs of the shard a word is second; (shard, w, total, n1, n2, n3): of the
    pairs in which a word is first, the words before them, and how many pairs have 1, 2, and 3 or more of those; and the numbers
    of n-grams of orders 2 and 3 that occur 1 to 4 times, with those of order 3 at all (0 times)."""

    def rows_of(row, words, *columns):
        import pyarrow as pa

        names = ["shard", "w", "n"] if len(columns) == 1 else ["shard", "w", "total", "n1", "n2", "n3"]
        shard = np.full(len(words), row.column("shard")[0].as_py(), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(words.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in columns)], names=names)

    def seconds(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                yield rows_of(row, *np.unique(_pairs_of(row)[1], return_counts=True))

    def firsts(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                b, _, size = _pairs_of(row)
                own = _groups(b)
                yield rows_of(row, b[own], *(_sum(x.astype(np.int64), own) for x in (size, size == 1, size == 2, size >= 3)))

    def few(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                size = np.frombuffer(row.column("size")[0].as_buffer(), np.uint32)
                n = _numbers(row.column("n")[0].as_buffer(), int(size.sum()))
                rows = [(order, times, int((c == times).sum())) for order, c in ((2, size), (3, n)) for times in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, (3, 0, len(n)), strict=True)], names=["k", "times", "m"])

    found = counts.select("size", "n").mapInArrow(few, "k long, times long, m long").groupBy("k", "times").agg(F.sum("m").alias("m")).collect()
    pairs = counts.select("shard", "b", "pairs", "w", "size", "words")
    first = pairs.mapInArrow(firsts, "shard long, w long, total long, n1 long, n2 long, n3 long")
    return pairs.mapInArrow(seconds, "shard long, w long, n long"), first, {(r["k"], r["times"]): r["m"] for r in found}


def _taken(n: np.ndarray, d: tuple) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


FOLLOWERS = "shard long, context binary, hash binary, n binary, q binary, hashes binary, values binary"


def by_file(table: DataFrame):
    """A function that reads columns of a shard of a stored table, within a task, from the shared folder: an Arrow table."""
    files: dict[int, list[str]] = {}
    for r in table.select("shard", F.input_file_name().alias("file")).distinct().collect():
        files.setdefault(r["shard"], []).append(r["file"])

    def read(shard: int, columns: list[str]):
        import pyarrow as pa
        import pyarrow.parquet as pq

        rows = []
        for file in files.get(shard, []):
            fs, where = file_system(file)
            rows.append(pq.read_table(where, filesystem=fs, filters=[("shard", "=", shard)], columns=columns))
        return pa.concat_tables(rows) if rows else pa.table({c: pa.array([], pa.binary()) for c in columns})

    return read


def _followers(counts: DataFrame, chances, contexts, d2: tuple, part: int, of: int, bits: int) -> DataFrame:
    """FOLLOWERS of one of a number of passes: of each run of three words, the hashes of its context and of itself, its count and what the pair of its last two
    words gives, by shards of the context's hash; and those pairs' own rows of the table, by shards of their hash.

    chances, contexts: read what the words of a shard have as second and as first words of pairs."""
    schema = FOLLOWERS

    def send(row):
        import pyarrow as pa

        a, b, w, n = _read(row)
        shard = row.column("shard")[0].as_py()

        def told(of, *columns: str):
            own = of(shard, list(columns))
            return [np.frombuffer(own.column(c)[0].as_buffer(), np.float64) for c in columns]

        pair = _groups(b, w)
        n2, b2, w2 = np.diff(np.append(pair, len(b))), b[pair], w[pair]
        (p1,), (total, gamma) = told(chances, "p"), told(contexts, "total", "gamma")
        first = _groups(b2)
        q, at = p1[np.searchsorted(np.unique(w2), w2)], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(b2))))
        p2 = (n2 - _taken(n2, d2)) / total[at] + gamma[at] * q
        hashes = chained(chained(_SEED, b2), w2)
        own = _part(hashes, of) == part
        hashes, values = hashes[own], np.log(p2[own] / q[own] / gamma[at[own]])
        context = chained(chained(_SEED, a), b)
        own = _part(context, of) == part
        context, w, n, q3 = context[own], w[own], n[own], np.repeat(p2, n2)[own]
        order, mine = np.argsort(context), np.argsort(hashes)
        context, hashes = context[order], hashes[mine]
        columns = context, _key(context, w[order]), n[order], q3[order], hashes, values[mine]
        shards = np.arange((1 << bits) + 1)
        ends, ends2 = np.searchsorted(_shards(context, bits), shards), np.searchsorted(_shards(hashes, bits), shards)
        rows = [
            (k, _deltas(context[i:j], k, bits), _bytes(columns[1][i:j] & ~_TOP), _bytes(columns[2][i:j]), columns[3][i:j].tobytes(), _deltas(hashes[l:m], k, bits), columns[5][l:m].tobytes())
            for k, (i, j, l, m) in enumerate(zip(ends, ends[1:], ends2, ends2[1:], strict=False)) if i < j or l < m
        ]
        out = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=[c.split()[0] for c in schema.split(", ")])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield send(batch.slice(k, 1))
        trim()

    return counts.mapInArrow(run, schema)


def _contexts(d3: tuple, bits: int):
    """All FOLLOWERS of a shard -> rows of TABLE of its contexts, runs of three words, and pairs."""

    def run(rows):
        shard, held = rows.column("shard")[0].as_py(), [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0))]
        for context, h, n, q in zip(*(rows.column(c).to_pylist() for c in ("context", "hash", "n", "q")), strict=True):
            if q is not None:  # single words have no followers here
                m = len(q) // 8
                context = _hashes(context, m, shard, bits)
                held.append((context, context & _TOP | _numbers(h, m).view(np.uint64), _numbers(n, m), np.frombuffer(q, np.float64)))
        context, h, n, q = map(np.concatenate, zip(*held, strict=True))
        order = np.argsort(context)
        context, h, n, q = context[order], h[order], n[order], q[order]
        own = _groups(context)
        size = np.diff(np.append(own, len(context)))
        taken, total = _taken(n, d3), _sum(n, own)
        gamma = _sum(taken, own) / total
        p3 = np.repeat(1 / total, size) * (n - taken) + np.repeat(gamma, size) * q
        pairs = [(_hashes(x, len(v) // 8, shard, bits), np.frombuffer(v)) for x, v in zip(rows.column("hashes").to_pylist(), rows.column("values").to_pylist(), strict=True)]
        hashes, values = map(np.concatenate, zip(*pairs, strict=True))
        return _packed(np.concatenate([hashes, context[own], h]), np.concatenate([values, np.log(gamma), np.log(p3 / q / np.repeat(gamma, size))]), bits)

    return run


TABLE = "shard long, hashes binary, values binary"


def _packed(hashes: np.ndarray, values: np.ndarray, bits: int):
    """A batch of TABLE: a row a shard of hashes, in ascending order; the values of a hash, as word and as context, are summed."""
    import pyarrow as pa

    order = np.argsort(hashes)
    hashes, values = hashes[order], values[order]
    first = _groups(hashes)
    hashes, values = hashes[first], _sum(values, first)
    ends = np.searchsorted(_shards(hashes, bits), np.arange((1 << bits) + 1))
    rows = [(k, hashes[i:j].tobytes(), values[i:j].tobytes()) for k, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if i < j]
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["shard", "hashes", "values"])


def _unpacked(rows) -> tuple[np.ndarray, np.ndarray]:
    parts = [[np.frombuffer(v, kind) for v in rows.column(c).to_pylist()] for c, kind in (("hashes", np.uint64), ("values", np.float64))]
    return np.concatenate([np.empty(0, np.uint64), *parts[0]]), np.concatenate([np.empty(0), *parts[1]])


def table_bits(table: DataFrame) -> int:
    """Bits of hashes that deal the table to its shards; a table that has more than the least number of shards has rows in all of them."""
    return max(TABLE_BITS, int(table.agg(F.max("shard")).first()[0] or 0).bit_length())


def known_filter(table: DataFrame) -> bytes:
    """A bit for each prefix of FILTER_BITS bits of a hash: whether a hash of the table begins so. Each shard has its own stretch of it."""
    bits = table_bits(table)
    stretch = (1 << FILTER_BITS - bits) >> 3

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                at = (np.frombuffer(batch.column("hashes")[k].as_buffer(), np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                own = np.zeros(8 * stretch, bool)
                own[at & (8 * stretch - 1)] = True
                packed = np.packbits(own, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(k, 1), pa.array([packed], pa.binary())], names=["shard", "bits"])

    def ored(rows):
        import pyarrow as pa

        every = np.bitwise_or.reduce([np.frombuffer(v, np.uint8) for v in rows.column("bits").to_pylist()])
        return pa.RecordBatch.from_arrays([pa.array([rows.column("shard")[0].as_py()], pa.int64()), pa.array([every.tobytes()], pa.binary())], names=["shard", "bits"])

    schema = "shard long, bits binary"
    found = {r["shard"]: bytes(r["bits"]) for r in by_shard(table.select("shard", "hashes").mapInArrow(run, schema), ored, schema).collect()}
    return b"".join(found.get(k, bytes(stretch)) for k in range(1 << bits))


def train(texts: DataFrame) -> tuple[DataFrame, float]:
    """The table (hash, value), packed in shards of hashes, and the log probability of a word that was never seen (base)."""
    base, parts = tables(counted(texts, shard_bits(texts)))
    return reduce(DataFrame.unionByName, parts), base


def tables(counts: DataFrame) -> tuple[float, Iterator[DataFrame]]:
    """The log probability of a word that was never seen, and the TRAIN_PASSES parts of the table, each made and stored when it is asked for, by stored counts of the texts, which
    go with the last part. The first has single words, too.

    A pair's shard knows the words before it; what its first and second word have in all shards is joined to the shards that have them."""
    from glyphmill.llm.kneser_ney import discounts

    pairs, opened, few = _of_counts(counts)
    one = store(pairs.groupBy("w").agg(F.sum("n").alias("n")), "words")
    stats = one.agg(F.count("*").alias("v"), F.sum("n").alias("total"), *[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    if not stats["v"]:
        discard(counts)
        return 0.0, iter([counts.sparkSession.createDataFrame([], TABLE)])
    d1 = discounts([stats[f"n{k}"] for k in (1, 2, 3, 4)])
    d2, d3 = (discounts([few.get((order, k), 0) for k in (1, 2, 3, 4)]) for order in (2, 3))
    taken = F.when(F.col("n") == 1, d1[0]).when(F.col("n") == 2, d1[1]).otherwise(d1[2])
    gamma = one.agg(F.sum(taken)).first()[0] / stats["total"]
    unseen = gamma / (stats["v"] + 1)
    p1 = one.select("w", ((F.col("n") - taken) / stats["total"] + F.lit(unseen)).alias("p"))
    weight = sum(F.col(f"n{k}") * d for k, d in enumerate(d2, 1)) / F.col("total")
    begun = store(opened.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("total", "n1", "n2", "n3")]).select("w", F.col("total").cast("double").alias("total"), weight.alias("gamma")), "begun")

    def by_words(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        """Rows (shard, w, columns) as a row a shard, with the columns packed by ascending w, stored."""

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                shard, *held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "w", *columns))
                order = np.argsort(shard, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
                    yield pa.RecordBatch.from_arrays([pa.array([shard[at[0]]], pa.int64()), *(pa.array([x[at].tobytes()], pa.binary()) for x in held)], names=["shard", "w", *columns])

        def together(rows):
            import pyarrow as pa

            w, *held = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint64 if c == "w" else np.float64) for c in ("w", *columns))
            order = np.argsort(w)
            return pa.RecordBatch.from_arrays([rows.column("shard").chunk(0).slice(0, 1), *(pa.array([x[order].tobytes()], pa.binary()) for x in held)], names=["shard", *columns])

        sent, schema = (", ".join(["shard long", *(f"{c} binary" for c in names)]) for names in (["w", *columns], columns))
        return by_shard(rows.select("shard", "w", *columns).mapInArrow(run, sent), together, schema, name=name)

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            w, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("w", "value"))
            for row in _packed(chained(_SEED, w.view(np.uint64)), value, bits).to_pylist():
                packed = _deltas(np.frombuffer(row["hashes"], np.uint64), row["shard"], bits)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), pa.array([packed], pa.binary()), pa.array([row["values"]], pa.binary())], names=["shard", "hashes", "values"])

    bits = min(_SHARED, max(TABLE_BITS, int(16 * 2 * few[3, 0] // TABLE_SHARD).bit_length()))
    chances = by_words(pairs.select("shard", "w").join(p1, "w"), ["p"], "chances")
    contexts = by_words(opened.select("shard", "w").join(begun, "w"), ["total", "gamma"], "contexts")
    told = by_file(chances), by_file(contexts)
    single = p1.select("w", F.log(F.col("p") / unseen).alias("value")).unionByName(begun.select("w", F.log("gamma").alias("value")))
    # Both of a word's values are of one hash, and are summed where its shard is put together.
    lower = store(single.groupBy("w").agg(F.sum("value").alias("value")).mapInArrow(words, TABLE), "lower")
    discard(one)
    discard(begun)

    def parts():
        for k in range(TRAIN_PASSES):
            rows = _followers(counts, *told, d2, k, TRAIN_PASSES, bits)
            rows = rows.unionByName(lower, allowMissingColumns=True) if k == 0 else rows
            part = by_shard(rows, _contexts(d3, bits), TABLE, name="ngram-values")
            for stored in [*((lower,) if k == 0 else ()), *((counts, chances, contexts) if k == TRAIN_PASSES - 1 else ())]:
                discard(stored)
            yield part

    return float(np.log(unseen)), parts()


SENT = "shard long, slice long, size long, hashes binary, n binary, texts binary, keys binary, words binary"


def dealt(texts: DataFrame, bits: int, copies: int, known: Broadcast, part: int = 0, of: int = 1) -> DataFrame:
    """texts (key, text): a row for each slice and shard, with the n-grams of the slice that this part of the table may have and the filter knows: their hashes, ascending, in how many
    places of texts each is, and those texts. The first row of a slice, which is always there, has the texts' keys
    and, with the first part, numbers of predicted words, too. A slice's number is the hash of its keys."""
    parts = of

    def run(batches):
        import pyarrow as pa
        import xxhash

        shards = np.arange((1 << bits) + 1)
        told = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            for rows_ in batches_of(batch, SLICE):
                keys = rows_.column("key").to_numpy().astype(np.int64)
                number = xxhash.xxh3_64_intdigest(keys.tobytes()) >> 1
                s, of = _slice(strings(rows_.column("text")))
                all_h, all_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

                def add(h, at):
                    prefix = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    good = (told[prefix >> 3] >> (prefix & 7).astype(np.uint8) & 1).astype(bool)
                    all_h.append(h[good])
                    all_of.append(of[at[good]])

                if len(s) and part == 0:
                    # Not the first edge, as the second alone is a context.
                    at = np.flatnonzero(of[1:] == of[:-1]) + 1
                    add(chained(_SEED, s[at]), at)
                if len(s):
                    h = chained(chained(_SEED, s[:-1]), s[1:])
                    at = np.flatnonzero((of[1:] == of[:-1]) & (_part(h, parts) == part))
                    add(h[at], at)
                    at = at[(at + 2 < len(s)) & (of[np.minimum(at + 2, len(s) - 1)] == of[at])]
                    add(_key(h[at], s[at + 2]), at)
                h, o = np.concatenate(all_h), np.concatenate(all_of)
                order = _ordered(h)
                h, o = h[order], o[order].astype(np.uint16 if len(keys) <= 65536 else np.uint32)
                ends = np.searchsorted(_shards(h, bits), shards)
                rows = []
                words = np.maximum(np.bincount(of, minlength=len(keys)) - (ORDER - 1), 0) if part == 0 else np.zeros(len(keys), np.int64)
                for k in range(1 << bits):
                    a, b = ends[k], ends[k + 1]
                    if a == b and k:
                        continue
                    first = _groups(h[a:b]) if a < b else np.zeros(0, np.int64)
                    n = np.diff(np.append(first, b - a))
                    once = (b"", b"") if rows else (keys.tobytes(), words.tobytes())
                    rows.append((k * copies + number % copies, number, len(first), _deltas(h[a:b][first], k, bits), _bytes(n), o[a:b].tobytes(), *once))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in SENT.split(", ")])
        trim()

    return texts.select("key", "text").mapInArrow(run, SENT)


MET = "slice long, keys binary, words binary, texts binary, value binary"


def meet(sent: DataFrame, table: DataFrame, bits: int, copies: int, tasks: int) -> DataFrame:
    """MET: what the texts of a slice get from a shard: the texts that get anything, by their places in the slice, and how much. The
    texts' rows are shuffled to their shard; its part of the table is read from the shared folder, where it was stored by shards, so it isn't shuffled."""
    rows_of = by_file(table)

    def loaded(shard: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows_of(shard, ["hashes", "values"])
        known, values = _unpacked(rows)
        if rows.num_rows < 2:
            return known, values
        order = np.argsort(known)  # of several parts
        return known[order], values[order]

    def run(batches):
        import pyarrow as pa

        shard, known, values = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                own = row.column("shard")[0].as_py() // copies
                if own != shard:
                    shard, (known, values) = own, loaded(own)
                size = row.column("size")[0].as_py()
                h, n = _hashes(row.column("hashes")[0].as_buffer(), size, own, bits), _numbers(row.column("n")[0].as_buffer(), size)
                of = np.frombuffer(row.column("texts")[0].as_buffer(), np.uint8)
                places = int(n.sum())
                of = of.view(np.uint16 if len(of) == 2 * places else np.uint32)
                value = np.zeros(len(h))
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    value = np.where(known[at] == h, values[at], 0.0)
                sums = np.bincount(of, np.repeat(value, n)) if places else np.zeros(0)
                got = np.flatnonzero(sums)
                columns = [got.astype(np.uint32).tobytes()], [sums[got].tobytes()]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("slice", "keys", "words")), *(pa.array(c, pa.binary()) for c in columns)], names=["slice", "keys", "words", "texts", "value"])
        trim()

    return sent.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, MET)


def _gathered(rows):
    """What a slice's texts get from all shards: (key, value, words). Slices of the same texts come as one; then values and words
    are of all of them."""
    import pyarrow as pa

    held = rows.to_pydict()
    keys = next(np.frombuffer(v, np.int64) for v in held["keys"] if v)
    value, words = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
    for texts, got in zip(held["texts"], held["value"], strict=True):
        value[np.frombuffer(texts, np.uint32)] += np.frombuffer(got, np.float64)
    for own in held["words"]:
        if own:
            words += np.frombuffer(own, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(value), pa.array(words)], names=["key", "value", "words"])


def sums(texts: DataFrame, size: int, table: DataFrame, part: int, of: int) -> DataFrame:
    """texts (key, text), of that length: (key, value, words), stored: what texts get from a part of the table, and with the first part their predicted words. Equal texts may come as several rows."""
    told = known_filter(table)
    bits, known = table_bits(table), texts.sparkSession.sparkContext.broadcast(told)
    batches = (MANY if np.bitwise_count(np.frombuffer(told, np.uint8)).sum() > 4 * len(told) else BATCHES) << (part == 0)
    copies = max(1, -(-size // batches // of // (GROUP_BYTES << bits)))
    tasks, done = max(shuffle_partitions(texts.sparkSession), copies << bits), None
    for k in range(batches):
        met = meet(dealt(texts.filter(F.pmod("key", F.lit(batches)) == k), bits, copies, known, part, of), table, bits, copies, tasks)
        rows = by_shard(met, _gathered, "key long, value double, words long", "slice", "sums")
        done = rows if done is None else done.unionByName(rows)
    known.destroy()  # all that it served is stored
    trim()  # what the filter took in the driver goes back to the system
    return done


def perplexity(parts: list[DataFrame], base: float) -> DataFrame:
    """(key, perplexity per word), stored, of the sums with all parts of the table; null for a text without words."""
    # Equal texts add up in both sums.
    every = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("value").alias("value"), F.sum("words").alias("words"))
    return store(every.select("key", F.when(F.col("words") > 0, F.exp(-F.lit(base) - F.col("value") / F.col("words"))).alias("perplexity")), "perplexity")


def perplexities(texts: DataFrame, table: DataFrame, base: float, parts: int = 1) -> DataFrame:
    """texts (key, text), where equal keys have equal texts: (key, perplexity per word) by a whole table, met in a number of parts."""
    size = length(texts)
    return perplexity([sums(texts, size, table, k, parts) for k in range(parts)], base)
