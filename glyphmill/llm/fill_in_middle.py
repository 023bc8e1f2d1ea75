"""Fill-in-the-middle: cut a text at token boundaries and reorder its parts, with whole numbers as bit sets.

A text's UTF-8 bytes become a number with one bit a byte (the first byte is the highest bit): ``bytes.translate``
writes a class mask as digits, and int(.., 2) reads them. Shifts and boolean operations on whole numbers then mark
boundaries of all tokens at once: a token ends at a byte that is no white space before one that is, or
before the end, and white space that ends a text is a token of its own. ``bit_count`` gives the number of tokens n, and
the end of the k-th is found by halving: count the upper half's bits and go on in the half that has the k-th.
All of it is linear in the text, with no object a token.

The form and the two cuts come from a document's id alone (``draws``), so repeated runs and lost executors change nothing.

Scale: no shuffle; a row is done where it is read.

Edges: a null text is empty, hence plain with n = 0; a null doc_id draws as the empty string; rows that repeat get equal
results; a text of white space alone is one token; one that contains a sentinel stays plain; an empty table gives no
row; other columns pass through ``transform`` untouched.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from glyphmill.llm.common import batches_of, documents, id_and_text, strings, text_or_empty

# Fixed values of the contract.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SEED, RATE, SPM_RATE = 42, 50, 80

#: Digits of class masks: white space, and the bytes that continue a code point.
_SPACES = bytes(0x31 if c in SPACE else 0x30 for c in range(256))
_CONTINUED = bytes(0x31 if 0x80 <= c < 0xC0 else 0x30 for c in range(256))


def class_mask(text: bytes, digits: bytes) -> int:
    return int(text.translate(digits), 2) if text else 0


def token_ends(text: bytes) -> int:
    """The bits of the last bytes of all tokens of a text."""
    if not text:
        return 0
    space = class_mask(text, _SPACES)
    word = space ^ ((1 << len(text)) - 1)
    # The byte after the text counts as white space; a last white space ends a token, too.
    return word & (space << 1 | 1) | space & 1


def ranked_bit(bits: int, size: int, rank: int) -> int:
    """The place, from the highest of size bits and from 0, of the rank-th set bit (from 1)."""
    place = 0
    while size > 1:
        low = size // 2
        upper = bits >> low
        n = upper.bit_count()
        if rank <= n:
            bits, size = upper, size - low
        else:
            bits, rank, place, size = bits & ((1 << low) - 1), rank - n, place + size - low, low
    return place


def code_points(text: bytes) -> int:
    return len(text) - class_mask(text, _CONTINUED).bit_count()


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    name = f"{SEED}:{'' if doc_id is None else doc_id}"
    return tuple(int(hashlib.sha256(name.encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24))


@dataclass(frozen=True)
class Transformed:
    n: int
    form: str
    prefix: bytes
    middle: bytes
    output: bytes


def transformed(text: bytes, drawn: tuple[int, int, int, int]) -> Transformed:
    h1, h2, h3, h4 = drawn
    ends = token_ends(text)
    n = ends.bit_count()
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= RATE:
        return Transformed(n, "plain", b"", b"", text)
    first, second = (ranked_bit(ends, len(text), k) + 1 if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < SPM_RATE:
        return Transformed(n, "spm", prefix, middle, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle)
    return Transformed(n, "psm", prefix, middle, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle)


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made of. Its parts hold no sentinel, so the first ones found are those that were put in."""
    if form == "plain":
        return output
    opened, parted = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(opened).split(parted, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def transform(docs: DataFrame) -> DataFrame:
    """docs, all columns, with text transformed and its form as _gm_form, which ``restore`` reads."""
    rows = docs.withColumn("_gm_id", docs["doc_id"].cast("long")).withColumn("_gm_text", text_or_empty(docs))
    at, width = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in batches_of(batch, column="_gm_text"):
                done = [transformed(t.encode(), draws(k)) for t, k in zip(strings(part.column(width + 1)), part.column(width).to_pylist(), strict=True)]
                columns = [pa.array([d.output.decode() for d in done], pa.string()) if k == at else part.column(k) for k in range(width)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([d.form for d in done], pa.string())], names=[*part.schema.names[:width], "_gm_form"])

    return rows.mapInArrow(run, StructType([*docs.schema.fields, StructField("_gm_form", StringType())]))


def restore(rows: DataFrame) -> DataFrame:
    """What ``transform`` made, as it was before (a null text is then empty)."""
    at = rows.columns.index("text")
    schema = rows.drop("_gm_form").schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in batches_of(batch):
                forms = part.column("_gm_form").to_pylist()
                texts = pa.array([restored(t.encode(), f).decode() for t, f in zip(strings(part.column(at)), forms, strict=True)], pa.string())
                columns = {c: texts if k == at else part.column(k) for k, c in enumerate(part.schema.names) if c != "_gm_form"}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, schema)


REPORT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def report(docs: DataFrame) -> DataFrame:
    """A row a document: tokens, form, lengths of the parts in code points, and digests of the output and of the text restored from it."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([pa.field(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in REPORT.split(", ")])
        for batch in batches:
            for part in batches_of(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), strings(part.column("text")), strict=True):
                    done = transformed(text.encode(), draws(doc_id))
                    sizes = (None, None) if done.form == "plain" else (code_points(done.prefix), code_points(done.middle))
                    digests = (hashlib.sha256(x).hexdigest() for x in (done.output, restored(done.output, done.form)))
                    rows.append((doc_id, done.n, done.form, *sizes, *digests))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return id_and_text(docs).mapInArrow(run, REPORT)


def op13_fillmiddle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))


ORACLE = f"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
         sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM tokens
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
