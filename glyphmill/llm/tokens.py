"""Byte-level BPE ids by the tokenizers library, asked once per distinct word.

The pre-tokenizer of a byte-level BPE starts a new piece at a space or line end that is the
first of a run of white space, and at the last one of a run before a word. A text in which
no space or line end is inside a run or ends the text within one can thus be cut before every space and
line end, and the cuts' ids, one after the other, are the text's. A cut that ends in marks
after a letter or digit is two pieces, so its body and its marks are looked up apart.

Texts are cut by Arrow, the distinct cuts of a slice are looked up in a table that the worker
keeps, and ids are gathered by offsets. Cuts that the table doesn't have go to
the library many at a time, as running text, in which every cut begins at an id whose token
begins with a space or line end. Texts that hold an added token (the library splits at those first)
or other runs of white space go to the library as they are, in stretches.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glyphmill.llm.common import batches_of, strings, trim

END_ID = 0
#: White space of any kind, for RE2, which knows ASCII's only.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space or line end inside a longer run of white space, or in one that ends the text.
_UNSAFE = rf"{_WHITE}[ \n](?:{_WHITE}|\z)"
_MARKS = ".,!?;:%*$&#|"
#: Letters and digits up to here are such in every version of Unicode.
_KNOWN = "԰"
_INNER_SPACE = re.compile(r"\s")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_SLICE, _STRETCH = 2 << 20, 1 << 16


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table:
    """Numbered runs of ids: run k is pool[start[k] : start[k] + size[k]]. Run 0 is empty."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.start, self.size, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._runs = 1

    def add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.number.update(zip(words, range(self._runs, self._runs + len(words)), strict=True))
        self._runs += len(words)
        self._new.append((sizes, ids))

    def close(self) -> None:
        """Takes in what was added."""
        if self._new:
            sizes = np.concatenate([s for s, _ in self._new])
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.pool = np.concatenate([self.pool, *(i for _, i in self._new)])
            self._new = []


class Encoder:
    """ids(texts) -> for each text, its ids as little-endian unsigned 32-bit bytes (no end id)."""

    def __init__(self, path: str, most_kept: int = 600_000, longest_kept: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        self._most, self._longest = most_kept, longest_kept
        known = self._tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(known.values()) + 1
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        #: Whether an id's token begins with a space or a line end, as byte-level vocabularies write them.
        self._opens = np.zeros(self.size, bool)
        self._opens[[k for token, k in known.items() if token[0] in "ĠĊ" and token not in self._added]] = True
        self._table, self._long = _Table(), []

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 256) for e in self._tokenizer.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]

    def _whole(self, text: str) -> bytes:
        """The ids of any text, in stretches that end before a space between two other characters."""
        stretches, at = [], 0
        while at < len(text):
            cut = _SAFE_CUT.search(text, at + _STRETCH)
            stretches.append(text[at : cut.start() if cut else len(text)])
            at += len(stretches[-1])
        return b"".join(np.array(e, "<u4").tobytes() for e in self._encode(stretches))

    def _learn(self, cuts: list[str]) -> None:
        """cuts: as they follow a space, or from a line end on, or marks after a zero byte."""
        apart = [c for c in cuts if c[:1] == "\0" or _INNER_SPACE.search(c, c[:1] == "\n") or c in ("", "\n")]
        odd = set(apart)
        self._long += [c for c in cuts if len(c) > self._longest]
        running = [c for c in cuts if c not in odd] if odd else cuts
        for at in range(0, len(running), 1 << 14):
            some = [c if c[0] == "\n" else " " + c for c in running[at : at + (1 << 14)]]
            each = self._encode(["".join(some[k : k + 64]) for k in range(0, len(some), 64)])
            ids = np.array([i for e in each for i in e], np.uint32)
            first = np.flatnonzero(self._opens[ids])
            if len(first) != len(some):
                raise ValueError("the vocabulary's tokens don't show where words begin")
            self._table.add(running[at : at + (1 << 14)], np.diff(np.append(first, len(ids))), ids)
        if apart:
            each = self._encode([c[1:] if c[:1] == "\0" else c if c[:1] == "\n" else " " + c for c in apart])
            self._table.add(apart, np.array([len(e) for e in each], np.int64), np.array([i for e in each for i in e], np.uint32))

    def _numbers(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each of distinct cuts the numbers of its body and of its marks (0: none)."""
        bodies = pc.ascii_rtrim(cuts, characters=_MARKS)
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(cuts), pc.binary_length(bodies)).to_numpy(zero_copy_only=False))
        ends = [(cut, len(body), body[-1:]) for cut, body in zip(strings(cuts.take(marked)), strings(bodies.take(marked)), strict=True)]
        apart = np.array([end < _KNOWN and end.isalnum() for _, _, end in ends], bool)
        if not apart.all():
            bodies = strings(bodies)
            for k in np.flatnonzero(~apart):
                bodies[marked[k]] = ends[k][0]
            bodies = pa.array(bodies, pa.string())
        coded = bodies.dictionary_encode()
        known, tails = strings(coded.dictionary), ["\0" + cut[n:] for (cut, n, _), own in zip(ends, apart, strict=True) if own]
        get = self._table.number.get
        first, second = list(map(get, known)), list(map(get, tails))
        if None in first or None in second:
            self._learn([c for c, k in zip(known, first, strict=True) if k is None] + sorted({c for c, k in zip(tails, second, strict=True) if k is None}))
            get = self._table.number.get
            first, second = list(map(get, known)), list(map(get, tails))
        marks = np.zeros(len(cuts), np.int64)
        marks[marked[apart]] = second
        return np.array(first, np.int64)[coded.indices.to_numpy()], marks

    def _cut(self, texts: pa.Array) -> list[bytes]:
        cuts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends = np.asarray(cuts.offsets)
        ends, flat = ends - ends[0], cuts.flatten()
        firsts = self._encode(strings(flat.take(pa.array(ends[:-1]))))
        coded = flat.dictionary_encode()
        body, marks = self._numbers(coded.dictionary)
        table, at = self._table, coded.indices.to_numpy()
        table.close()
        runs = np.stack([body[at], marks[at]], axis=1)
        runs[ends[:-1]] = 0  # no space comes before a text's first cut
        runs = runs.ravel()
        sizes = table.size[runs]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = table.pool[np.repeat(table.start[runs] - total[:-1], sizes) + np.arange(total[-1])].astype("<u4").tobytes()
        stops = (4 * total[2 * ends]).tolist()
        return [np.array(first, "<u4").tobytes() + ids[a:b] for first, a, b in zip(firsts, stops, stops[1:], strict=False)]

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = pc.or_(pc.match_substring_regex(column, _UNSAFE), pc.match_substring(column, "\0"))
        for token in self._added:
            odd = pc.or_(odd, pc.match_substring(column, token))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(column)
        if not odd.all():
            for k, ids in zip(np.flatnonzero(~odd), self._cut(column.filter(pa.array(~odd)) if odd.any() else column), strict=True):
                out[k] = ids
        for k in np.flatnonzero(odd):
            out[k] = self._whole(column[int(k)].as_py())
        number = self._table.number
        if len(number) > self._most:
            self._table = _Table()
        else:
            # Long words hardly come again; their ids stay in the pool until all is cleared.
            for word in self._long:
                number.pop(word, None)
        self._long = []
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and vocabulary file; the worker keeps its table of words between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterable, path: str) -> Iterator[tuple[object, list[bytes]]]:
    """(slice of the Arrow batch, ids of its texts) for every slice of about 2 MB of text."""
    enc = encoder(path)
    for batch in batches:
        for part in batches_of(batch, _SLICE):
            yield part, enc.ids(part.column("text"))
    trim()
