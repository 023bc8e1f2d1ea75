"""Exact token counts of every prefix, by dynamic programming over the places of a text.

In a byte-pair vocabulary the pieces of a text are right if and only if each two neighbours
are: merges are taken by score and then from the left, so what happens inside two
neighbouring pieces doesn't depend on the rest until a merge crosses a piece's edge, and the first one that does
crosses it in the text of these two alone as well. Hence the pieces of a prefix end in the one piece t for which
the pieces of the prefix before t end in a neighbour that t is right after:

    n(0) = 0,    n(i) = n(i - |t|) + 1,    last(i) = t.

No piece of the vocabulary has a space after another character (checked on loading), so texts are
cut before every run of spaces, the program runs once a distinct cut, and the counts of all prefixes of
a text are those of its cuts on top of the sums of the cuts before. A character that the
vocabulary lacks is as many tokens as it has UTF-8 bytes.

``prefix_table`` stores, for every text, the steps from each prefix's count to the next (a byte each, or four
where one is larger). ``totals``, ``fits`` and ``tokens_at`` answer questions on lengths and budgets from
that table; nothing is encoded again. Counts don't always grow with the prefix ("hell" may have more tokens than
"hello"), so ``fits`` gives the longest prefix within a budget, not the first one over it.

Scale: one pass over the texts without a shuffle; a worker's table of cuts is bounded; a row of the stored table
is about as large as its text.

Edges: a null text is empty and has no token; rows of one doc_id are rows of their own, and a question
meets them all; a null doc_id passes through, but no question finds it; a question below 0 or beyond
the end counts as 0 or the whole text, a null one gives null; an empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, documents, id_and_text, store, strings, trim

LIMIT = 4096
_SPACE, _SLICE, _MOST_CUTS, _LONGEST_KEPT, _MOST_PAIRS, _CACHE_BITS = "▁", 2 << 20, 600_000, 64, 500_000, 21
#: Texts in which vocabularies that normalise, or whose own rules differ, show it.
_PROBES = ("", " ", "a", "  a  b ", "ﬁ Ａ１ x", "▁a ▁", "\n\t\x00", "aaaaaaaaaaaaaaaaa", "<s>a</s><unk><0x0A>", "日本語 Ñandú", "𝒜é́", "-" * 40, " " * 40 + "x", "hello\u00a0\u200bworld")


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounter:
    """The program over cuts of texts. Cuts are kept with their steps: what each character adds to the count of the prefix before it."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = [library.is_byte, library.is_control, library.is_unknown, library.is_unused]
        ids = [k for k in range(library.get_piece_size()) if not any(f(k) for f in odd)]
        self._score = {library.id_to_piece(k): library.get_score(k) for k in ids}
        if any(_SPACE in piece.lstrip(_SPACE) or "\n" in piece or "\0" in piece for piece in self._score):
            raise ValueError("the vocabulary has pieces with a space after another character, line ends or zeros")
        # Pieces have numbers from 1; 0 stands before a cut's first piece and for characters without a piece.
        self._pieces = ["", *self._score]
        self._found = ahocorasick.Automaton()
        for number, piece in enumerate(self._pieces[1:], 1):
            self._found.add_word(piece, number)
        self._found.make_automaton()
        self._length = np.array([len(piece) for piece in self._pieces], np.int64)
        self._right: dict[int, bool] = {}
        self._cached_keys = np.full(1 << _CACHE_BITS, -1, np.int64)
        self._cached = np.zeros(1 << _CACHE_BITS, bool)
        self._forget()
        for probe in _PROBES:
            if int(self.counts(probe)[-1]) != len(library.encode(probe)):
                raise ValueError(f"the vocabulary's own rules differ from this program's at {probe!r}")

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._starts, self._sizes, self._pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _stands(self, before: str, piece: str) -> bool:
        """Whether before and piece are the pieces of their text, by the definition: the best merge first, from the left."""
        parts, edge = [*before, *piece], len(before)
        get = self._score.get
        scores = [get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, 0
            for k, s in enumerate(scores):
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return len(parts) == (2 if before else 1)
            if at + 1 == edge:
                return False
            if at < edge:
                edge -= 1
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1])

    def _follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """For pairs of numbers, whether the second piece is right after the first."""
        keys = before << 20 | piece
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        out = self._cached[slots]
        missed = np.flatnonzero(self._cached_keys[slots] != keys)
        if len(missed):
            new, at = np.unique(keys[missed], return_inverse=True)
            known, names = [], self._pieces
            for key in new.tolist():
                right = self._right.get(key)
                if right is None:
                    if len(self._right) >= _MOST_PAIRS:
                        self._right.clear()
                    right = self._right[key] = self._stands(names[key >> 20], names[key & 0xFFFFF])
                known.append(right)
            out[missed] = np.array(known)[at]
            self._cached_keys[slots[missed]], self._cached[slots[missed]] = keys[missed], out[missed]
        return out

    def _learn(self, cuts: list[str]) -> None:
        """Runs the program over new cuts side by side: place by place, all pieces that end there are tried behind the pieces before."""
        sizes = np.array([len(c) for c in cuts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        text = "\0".join(cuts)
        found = np.fromiter(chain.from_iterable(self._found.iter(text)), np.int64).reshape(-1, 2)
        end, piece = found[:, 0], found[:, 1]
        of = np.repeat(np.arange(len(cuts)), sizes + 1)[: len(text)]
        inside = np.ones(len(text), bool)
        inside[starts[1:] - 1] = False
        alone = inside.copy()
        alone[end[self._length[piece] == 1]] = False
        alone = np.flatnonzero(alone)
        cost = np.ones(len(end) + len(alone), np.int32)
        cost[len(end) :] = [len(text[k].encode()) for k in alone.tolist()]
        end, piece = np.concatenate([end, alone]), np.concatenate([piece, np.zeros(len(alone), np.int64)])
        place = end - starts[of[end]]
        order = np.argsort(place, kind="stable")
        end, piece, cost = end[order], piece[order], cost[order]
        start = end - np.maximum(self._length[piece], 1)
        # The last element stands before the first cut, as the zeros between cuts do before the others.
        counts, last = np.zeros(len(text) + 1, np.int32), np.zeros(len(text) + 1, np.int64)
        bounds = np.searchsorted(place[order], np.arange(int(sizes.max(initial=0)) + 1)).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            p, q, own = end[a:b], start[a:b], piece[a:b]
            right = np.flatnonzero(self._follow(last[q], own) | (own == 0))
            last[p[right]] = own[right]
            counts[p[right]] = counts[q[right]] + cost[a:b][right]
        steps = np.diff(counts[: len(text)], prepend=np.int32(0))[inside]
        # Between cuts the count is 0, so a cut's first step is its first count.
        self._number.update(zip(cuts, range(len(self._starts), len(self._starts) + len(cuts)), strict=True))
        self._starts = np.concatenate([self._starts, len(self._pool) + np.cumsum(sizes) - sizes])
        self._sizes = np.concatenate([self._sizes, sizes])
        self._pool = np.concatenate([self._pool, steps])

    def counts(self, text: str) -> np.ndarray:
        """The token counts of the prefixes of 0, 1, ... characters."""
        return _unpacked(self.packed([text])[0])

    def packed(self, texts: list[str]) -> list[bytes]:
        """For each text its steps, packed as bytes."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pa.array(texts, pa.string())
        # The library's mark for spaces is a space, too, and it puts one before every text.
        if pc.any(pc.match_substring(column, _SPACE)).as_py():
            column = pc.replace_substring(column, _SPACE, " ")
        runs = pc.or_(pc.match_substring(column, "  "), pc.starts_with(column, " ")).to_numpy(zero_copy_only=False)
        cuts = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        ends = np.asarray(cuts.offsets)
        ends, flat = ends - ends[0], cuts.flatten()
        if runs.any():
            # Cuts after a space keep it to themselves; runs of spaces belong to the cut behind them.
            lists = [_whole_cuts(t) if r else None for t, r in zip(strings(column), runs, strict=True)]
            plain = strings(flat)
            parts = [plain[a:b] if own is None else own for own, a, b in zip(lists, ends.tolist(), ends[1:].tolist(), strict=False)]
            ends, flat = np.cumsum([0, *map(len, parts)]), pa.array([c for own in parts for c in own], pa.string())
        coded = flat.dictionary_encode()
        distinct = [(c if c[:1] == "\n" else _SPACE + c).replace(" ", _SPACE) for c in strings(coded.dictionary)]
        get = self._number.get
        numbers = [get(c) for c in distinct]
        if None in numbers:
            self._learn([c for c, k in zip(distinct, numbers, strict=True) if k is None])
            get = self._number.get
            numbers = [get(c) for c in distinct]
        run = np.array(numbers, np.int64)[coded.indices.to_numpy()]
        sizes = self._sizes[run]
        total = np.concatenate([[0], np.cumsum(sizes)])
        steps = self._pool[np.repeat(self._starts[run] - total[:-1], sizes) + np.arange(total[-1])]
        first, stop = total[ends[:-1]], total[ends[1:]]
        # The space before a text is no character of it: what it counts goes to the text's first, if there is any.
        first, stop = total[ends[:-1]], total[ends[1:]]
        some = first[stop - first > 1]
        steps[some + 1] += steps[some]
        narrow = not len(steps) or (steps.min() >= -128 and steps.max() <= 127)
        out = [_packed(steps[a:b]) for a, b in zip((first + 1).tolist(), stop.tolist(), strict=True)] if not narrow else None
        if narrow:
            whole = steps.astype("i1").tobytes()
            out = [b"\1" + whole[a:b] for a, b in zip((first + 1).tolist(), stop.tolist(), strict=True)]
        if len(self._number) > _MOST_CUTS or len(self._pool) > 16 * _MOST_CUTS:
            self._forget()
        else:
            for cut in distinct:
                if len(cut) > _LONGEST_KEPT:
                    self._number.pop(cut)
        return out


def _whole_cuts(text: str) -> list[str]:
    """The cuts of a text with runs of spaces, each without its first space."""
    return [c[1:] if c[:1] == " " else c for c in re.findall(r" +[^ \n]*|\n[^ \n]*", " " + text)]


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter a Python worker and vocabulary file; the worker keeps its table of cuts between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _packed(steps: np.ndarray) -> bytes:
    """Steps as bytes, after one that says how many a step takes."""
    narrow = not len(steps) or (steps.min() >= -128 and steps.max() <= 127)
    return (b"\1" + steps.astype("i1").tobytes()) if narrow else (b"\4" + steps.astype("<i4").tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    """The counts of the prefixes of 0, 1, ... characters."""
    steps = np.frombuffer(packed, "i1" if packed[:1] == b"\1" else "<i4", offset=1)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


TABLE = "doc_id long, n_bytes long, steps binary"


def prefix_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, steps), stored in the shared folder: the token counts of all prefixes of all texts."""
    path = path or vocabulary()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        count = counter(path)
        for batch in batches:
            for part in batches_of(batch, _SLICE):
                texts = part.column("text")
                sizes = pc.cast(pc.binary_length(texts), pa.int64())
                packed = pa.array(count.packed(strings(texts)), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, packed], names=["doc_id", "n_bytes", "steps"])
        trim()

    return store(id_and_text(docs), "prefix-tokens", run, TABLE)


def _answered(rows: DataFrame, answer, columns: str) -> DataFrame:
    """rows with a column steps -> the other columns and what answer(counts, row) says, as columns of longs."""
    names = [c for c in rows.columns if c != "steps"]
    added = [c.split()[0] for c in columns.split(",")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in batches_of(batch, _SLICE, "steps"):
                others = [part.column(c) for c in names]
                rows = zip(*[c.to_pylist() for c in others], strict=True)
                said = [answer(_unpacked(s), dict(zip(names, row, strict=True))) for s, row in zip(strings(part.column("steps")), rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*others, *(pa.array(c, pa.int64()) for c in zip(*said, strict=True))], names=[*names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.select(*names, "steps").mapInArrow(run, f"{kinds}, {columns}")


def totals(table: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of the whole texts."""
    return _answered(table, lambda counts, _: (int(counts[-1]),), "n_tokens long")


def fits(table: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fit_chars): fit_chars is the length of the longest prefix of at most limit tokens."""

    def answer(counts: np.ndarray, _: dict) -> tuple[int, int]:
        whole = int(counts[-1])
        return whole, len(counts) - 1 if whole <= limit else int(np.flatnonzero(counts <= limit)[-1])

    return _answered(table, answer, "n_tokens long, fit_chars long")


def tokens_at(table: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (doc_id, chars): (doc_id, chars, n_tokens), the tokens of the text's first chars characters."""
    asked = questions.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chars").cast("long").alias("chars"))

    def answer(counts: np.ndarray, row: dict) -> tuple[int | None]:
        chars = row["chars"]
        return (None if chars is None else int(counts[min(max(chars, 0), len(counts) - 1)]),)

    return _answered(table.select("doc_id", "steps").join(asked, "doc_id"), answer, "n_tokens long")


def truncated(docs: DataFrame, table: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs, all columns, with texts cut to their longest prefix of at most limit tokens. doc_ids are to be unique."""
    ends = fits(table, limit).select(F.col("doc_id").alias("_gm_id"), F.col("fit_chars").alias("_gm_chars"))
    cut = F.expr("substring(text, 1, CAST(coalesce(_gm_chars, char_length(text)) AS INT))")
    return docs.join(ends, docs["doc_id"].cast("long") == ends["_gm_id"], "left").withColumn("text", cut).select(docs.columns)


def op12_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fits(prefix_table(documents(spark, sf_dir)))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars")
