"""Secret scans: credential patterns, and the guess cost of values in credential contexts.

The base patterns (assignments, access keys, long hexadecimal runs) give spans of
kinds assign, access and hex. The method adds spans of kind guess: for every
value that stands in a credential context (password, pin, login, auth ... with
``:``, ``=`` or "is"), a dynamic program finds the cheapest way to guess it, as a
product over k segments that are dictionary words, dates, repeats, keyboard walks
or brute force, times the k! orders they could have; a value that costs at least
``threshold`` guesses (in decimal digits) is a secret, "password: house" is not.

    cost(k, j) = min over segments i..j of cost(k - 1, i) + digits(segment)
    total      = min over k of cost(k, n) + log10(k!)

The minimum is exact: k goes up until log10(k!) alone is over the best total (or over the
threshold, where only that matters). Brute-force spans take a running minimum, and long repeats and
walks start and end within a longest word's length of their run's ends, as anything between is
never cheaper; so work is linear in the value, whatever its length.

The dictionary is ranked by how many documents of the scanned table have a word: its RANKED most
frequent ones, counted over all texts (``ranked_words``), so it speaks the corpus's languages; a few
notorious passwords come first. Values that are placeholders (``${NAME}``, ``%s``, ``<name>``, ``xxxx``)
or read from code (``os.environ.get``) aren't secrets.

Scale: words are counted per task before they are shuffled; the dictionary is bounded by RANKED words of at
most LONGEST_WORD letters, 1 MB, and goes to the tasks. Texts aren't shuffled. Whole texts are scanned.

Edges: a null or empty text has no span; offsets count code points; repeated
rows are scanned alike; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, documents, id_and_text, keep, strings

# Fixed values of the base patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8

_LONG = r"password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential"
_SHORT = r"(?:(?<![A-Za-z])(?ai:pin|auth|login)|(?<=[a-z0-9])(?:Pin|Auth|Login))(?![a-z])"
#: Contexts of the method: names that hold a keyword, with whatever before and after it (short keywords only as a part of
#: their own: auth_token, userPin, not author), and before "is" names that end with one. A value ends at white space, a quote,
#: a comma, a semicolon or a bracket.
CONTEXT = re.compile(
    rf"""(?:(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]*?(?:(?ai:{_LONG})|{_SHORT}))[A-Za-z0-9_.-]++["']?\x20*[:=]\x20*"""
    rf"""|(?<![A-Za-z0-9])(?ai:(?:{_LONG})|credentials|pin|auth|login)["']?\x20+is\x20+)["']?([^\s"',;()<>\[\]{{}}]{{4,}})"""
)
THRESHOLD = 8.0
RANKED, LONGEST_WORD, LEAST_DOCUMENTS = 20_000, 20, 10

#: Notorious passwords and words of credentials, cheapest first; the corpus's words come after them.
NOTORIOUS = [
    "password", "admin", "welcome", "login", "letmein", "master", "secret", "love", "money", "house", "dragon", "monkey", "football", "baseball",
    "sunshine", "princess", "shadow", "summer", "winter", "spring", "autumn", "hello", "world", "test", "user", "root", "guest", "token", "key", "access",
    "private", "public", "server", "data", "base", "code", "name", "account", "change", "please", "enter", "your", "none", "null", "true", "false",
    "example", "default", "required", "optional", "string", "value", "file", "path", "here", "chocolate", "elephant", "configuration",
]
#: Keys of a keyboard by rows, each row shifted to the right of the one above; and the number pad.
BOARD, PAD = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"], ["789", "456", "123"]
SHIFTED = dict(zip('!@#$%^&*()_+{}:"<>?', "1234567890-=[];',./", strict=True))
DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d))")
#: Values that name something instead of being it.
PLACEHOLDER = re.compile(r"\$\{?\w+\}?|\$\(.*|%\(?\w*\)?[sd]|<.*|\{\{?.*|\*+|[xX.]+|(?:os|process|sys|env|config|settings|self|this|request|args|params)(?:\.\w+)+")
_LEET = str.maketrans("013457@$!", "oleastasi")


def _neighbours() -> set[str]:
    """Pairs of keys that touch, in one direction at a time: rows to both sides, and the keys above and below; letters of the alphabet."""
    pairs: set[str] = set()
    for rows, shift in ((BOARD, 1), (PAD, 0)):
        for y, row in enumerate(rows):
            for x, key in enumerate(row):
                for dy, dx in ((0, 1), (1, 0), (1, -1)) if shift else ((0, 1), (1, 0), (1, 1), (1, -1)):
                    below = rows[y + dy] if y + dy < len(rows) else ""
                    if 0 <= x + dx < len(below):
                        pairs |= {key + below[x + dx], below[x + dx] + key}
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    return pairs | {a + b for a, b in zip(alphabet, alphabet[1:], strict=False)} | {b + a for a, b in zip(alphabet, alphabet[1:], strict=False)}


_NEXT = _neighbours()
WORDS = {w: k + 1 for k, w in enumerate(NOTORIOUS)}


def dictionary(corpus_words: list[str]) -> dict[str, int]:
    """word -> rank from 1: the notorious ones, then the corpus's as given."""
    out = dict(WORDS)
    for w in corpus_words:
        out.setdefault(w, len(out) + 1)
    return out


def _brute(c: str) -> float:
    """Digits of one character's guesses, from its class."""
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33 if c.isascii() else 100)


def _ends(start: int, end: int, least: int, near: int, step: int = 1):
    """(i, j) of segments within a run that start and end near its ends: all of them in a short run."""
    starts = range(start, min(end, start + near) + 1)
    for i in starts:
        last = i + (end - i) // step * step
        first = i + -(-least // step) * step
        yield from ((i, j) for j in range(max(first, last - -(-near // step) * step), last + 1, step))


def segments_of(value: str, words: dict[str, int] = WORDS) -> list[tuple[int, int, float, str]]:
    """(start, end, digits, kind) of all segments but brute-force ones that a cheapest segmentation can have."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters grow when lower-cased
        low = value
    plain = low.translate(_LEET)
    found: list[tuple[int, int, float, str]] = []
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = words.get(plain[i:j])
            if rank:
                varied = sum(a != b for a, b in zip(value[i:j], plain[i:j], strict=True))
                found.append((i, j, math.log10(rank + 1) + 0.3 * varied, "word"))
        if value[i].isdigit() and value[i].isascii() and (m := DATE.match(value, i)):
            found.append((i, m.end(), 2.2 if m.end() - i == 4 else 4.6, "date"))
    keys = "".join(SHIFTED.get(c, c) for c in low)
    at = 0
    while at < n - 1:
        end = at + 1
        while end < n and keys[end - 1 : end + 1] in _NEXT:
            end += 1
        found += [(i, j, 1.7 + math.log10(j - i), "walk") for i, j in _ends(at, end, 3, LONGEST_WORD)]
        at = max(at + 1, end - 1)
    for width in (1, 2, 3, 4):
        at = 0
        while at + 2 * width <= n:
            end = at + width
            while end < n and low[end] == low[end - width]:
                end += 1
            if end - at >= max(3, 2 * width):
                for i, j in _ends(at, end, max(3, 2 * width), LONGEST_WORD + width, width):
                    found.append((i, j, sum(map(_brute, low[i : i + width])) + math.log10((j - i) // width), "repeat"))
            at = max(at + 1, end - 2 * width + 1)
    return found


def guess_digits(value: str, words: dict[str, int] = WORDS, enough: float = math.inf) -> tuple[float, list[tuple[str, int, int]]]:
    """(log10 of the cheapest guess count, segments as (kind, start, end)). From ``enough`` on the count is only known to be so much."""
    n = len(value)
    if not n:
        return 0.0, []
    into: dict[int, list[tuple[int, float, str]]] = {}
    for i, j, digits, kind in segments_of(value, words):
        into.setdefault(j, []).append((i, digits, kind))
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + _brute(c))
    before, backs = [0.0] + [math.inf] * n, []
    best, best_k, k = math.inf, 0, 0
    while k < n and math.lgamma(k + 2) / math.log(10) < min(best, enough):
        k += 1
        now, back = [math.inf] * (n + 1), [(0, "")] * (n + 1)
        least, least_at = math.inf, 0  # of before[i] - brute[i]
        for j in range(1, n + 1):
            if before[j - 1] - brute[j - 1] < least:
                least, least_at = before[j - 1] - brute[j - 1], j - 1
            now[j], back[j] = least + brute[j], (least_at, "brute")
            for i, digits, kind in into.get(j, ()):
                if before[i] + digits < now[j] - 1e-12:
                    now[j], back[j] = before[i] + digits, (i, kind)
        backs.append(back)
        total = now[n] + math.lgamma(k + 1) / math.log(10)
        if total < best - 1e-12:
            best, best_k = total, k
        before = now
    segments, j = [], n
    for back in reversed(backs[:best_k]):
        i, kind = back[j]
        segments.append((kind, i, j))
        j = i
    return best, segments[::-1]


def is_secret(value: str, words: dict[str, int] = WORDS, threshold: float = THRESHOLD) -> bool:
    return not PLACEHOLDER.fullmatch(value) and guess_digits(value, words, threshold)[0] >= threshold


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), ordered by start and then kind as in KINDS."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in found]


def guess_spans(text: str, threshold: float = THRESHOLD, words: dict[str, int] = WORDS) -> Iterator[tuple[int, int, str]]:
    for m in CONTEXT.finditer(text):
        if is_secret(m[1], words, threshold):
            yield m.start(1), m.end(1), "guess"


def spans_of(text: str, threshold: float = THRESHOLD, words: dict[str, int] = WORDS) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans): the method's spans come after the base kinds where starts are equal."""
    base = base_spans(text)
    order = (*KINDS, "guess").index
    return base, sorted([*base, *guess_spans(text, threshold, words)], key=lambda s: (s[0], order(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def ranked_words(docs: DataFrame, most: int = RANKED, least: int = LEAST_DOCUMENTS) -> list[str]:
    """The most frequent words of the texts, of 3 to LONGEST_WORD letters that stand alone, by the number of documents that have them,
    which is at least least: what a few documents have may be a secret. At most most of them: as many whole classes of frequency
    (eighths of a power of two) as fit, so that the classes' sizes, some hundred numbers, say which words to fetch."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[\s.,;:!?\"()]+"))
    each = docs.select(F.explode(words).alias("word")).filter(F.length("word").between(3, LONGEST_WORD))
    counted = each.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & F.rlike("word", F.lit(r"^\p{L}+$")))
    known = keep(counted.withColumn("class", F.floor(F.log2("n") * 8)))
    room, lowest = most, None
    for r in sorted(known.groupBy("class").agg(F.count("*").alias("m")).collect(), key=lambda r: -r["class"]):
        if r["m"] > room:
            break
        room, lowest = room - r["m"], r["class"]
    if lowest is None:
        return []
    return [r["word"] for r in sorted(known.filter(F.col("class") >= lowest).collect(), key=lambda r: (-r["n"], r["word"]))]


def scan(docs: DataFrame, threshold: float = THRESHOLD, ranked: int = RANKED) -> DataFrame:
    known = dictionary(ranked_words(docs, ranked) if ranked else [])

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            for part in batches_of(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), strings(part.column("text")), strict=True):
                    base, spans = spans_of(text, threshold, known)
                    n = [sum(s[2] == kind for s in base) for kind in KINDS]
                    rows.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
                kinds = [pa.string() if c in ("base_sha256", "spans") else pa.int64() for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return id_and_text(docs).mapInArrow(run, RESULT)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
