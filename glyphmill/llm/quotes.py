"""Quotation linking: from quoted lines to reply-ordered conversations.

Lines that begin with ``>`` marks are quotes of the level that counts the marks.
Consecutive lines of one level make a passage. A passage and, if it has several
lines, each of its lines are normalised (marks off, white space collapsed, lower
case) and hashed; so are the paragraphs and lines that messages say themselves. A
message's *parent* is the message that first said what it quotes: in its own
conversation if one did so before it, else in any earlier conversation. The
shallowest level with a match counts, so deeper quotes link messages whose reply in
between was trimmed or never stored. Of several parents at that level the one whose
quotes match most often counts, then the latest.

Replies are ordered below the message that they go back to: by thread, the root's
turn, depth, conversation and turn. The text that is returned has no quotes.

Scale: hashes are counted before they are joined: a hash has one first sayer, so
the joins are with one row a key, and a phrase that everyone says skews only the
side that adaptive execution splits. Depths come from pointer doubling, a stored
table a round, so their number grows with the logarithm of the longest chain; messages
without replies in them take no round. Sorting is by range of the whole key.

Edges: a null text has no line and an empty body; short units (under LEAST
characters) link only within their conversation; messages never link to later ones or themselves, so
there are no cycles; rows of one (conv_id, turn) are one message in the tree, linked by
the quotes of all of them, and every distinct text of it is kept as a row; rows with a null conv_id or turn link nothing and are their own roots; an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import batches_of, keep, store, strings

LEAST = 12
_QUOTE = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.S)
_INTRO = re.compile(r"(?i)^\s*(?:on\b.*\bwrote|el\b.*\bescribió|le\b.*\ba écrit|am\b.*\bschrieb)\s*:\s*$")


def split_levels(text: str) -> list[tuple[int, list[str]]]:
    """Blocks of consecutive lines of one quote level (0: own words), marks taken off; blank lines end a block."""
    out: list[tuple[int, list[str]]] = []
    open_ = False
    for line in text.split("\n"):
        m = _QUOTE.match(line)
        level, words = (m[1].count(">"), m[2]) if m else (0, line)
        if not words.strip():
            open_ = False
        elif open_ and out[-1][0] == level:
            out[-1][1].append(words)
        else:
            out.append((level, [words]))
            open_ = True
    return out


def body_of(text: str) -> str:
    """A message without quoted lines and the lines that introduce them; blank lines are kept single."""
    lines = text.split("\n")
    kept: list[str] = []
    for k, line in enumerate(lines):
        if _QUOTE.match(line):
            continue
        if _INTRO.match(line) and k + 1 < len(lines) and _QUOTE.match(lines[k + 1]):
            continue
        if line.strip() or (kept and kept[-1].strip()):
            kept.append(line)
    return "\n".join(kept).strip("\n")


def normalised(lines: list[str]) -> str:
    return " ".join(" ".join(lines).lower().split())


def units(text: str) -> list[tuple[int, bytes, bool]]:
    """(level, hash, whether it is long enough for other conversations) of every passage and of every line of longer passages."""
    import xxhash

    out = []
    for level, lines in split_levels(text):
        for unit in [lines] + ([[line] for line in lines] if len(lines) > 1 else []):
            words = normalised(unit)
            if words:
                out.append((level, xxhash.xxh3_128_digest(words), len(words) >= LEAST))
    return out


PARSED = "conv_id long, turn long, role string, body string, max_level int, n_quotes long, units array<struct<level:int,hash:binary,wide:boolean>>"


def parsed(messages: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("wide", pa.bool_())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), kind]
        names = ["conv_id", "turn", "role", "body", "max_level", "n_quotes", "units"]
        for batch in batches:
            for part in batches_of(batch):
                rows = []
                for conv, turn, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn")), strings(part.column("role")), strings(part.column("text")), strict=True):
                    levels = [level for level, _ in split_levels(text) if level]
                    own = [{"level": level, "hash": h, "wide": wide} for level, h, wide in units(text)]
                    rows.append((conv, turn, role, body_of(text), max(levels, default=0), len(levels), own))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    narrow = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return narrow.mapInArrow(run, PARSED)


def parents(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_conv, parent_turn, n_matches) of messages whose quotes have an earlier sayer, at the shallowest level that has."""
    each = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("units").alias("x"))
    each = each.select("conv_id", "turn", F.col("x.level").alias("level"), F.col("x.hash").alias("hash"), F.col("x.wide").alias("wide"))
    said, quoted = each.filter("level = 0"), each.filter("level > 0").distinct()
    here = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("own_turn"))
    first = F.min(F.struct("conv_id", "turn"))
    anywhere = said.filter("wide").groupBy("hash", "conv_id").agg(F.min("turn").alias("turn")).groupBy("hash").agg(first.alias("f"))
    anywhere = anywhere.select("hash", F.col("f.conv_id").alias("far_conv"), F.col("f.turn").alias("far_turn"))
    asked = quoted.join(here, ["conv_id", "hash"], "left").join(anywhere, "hash", "left")
    near = F.col("own_turn") < F.col("turn")
    far = F.col("far_conv") < F.col("conv_id")
    return (
        asked.select(
            "conv_id", "turn", "level",
            F.when(near, F.col("conv_id")).when(far, F.col("far_conv")).alias("parent_conv"),
            F.when(near, F.col("own_turn")).when(far, F.col("far_turn")).alias("parent_turn"),
        )
        .filter("parent_conv IS NOT NULL")
        .groupBy("conv_id", "turn", "level", "parent_conv", "parent_turn").agg(F.count("*").alias("n"))
        .groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("up"), "n", "parent_conv", "parent_turn")).alias("p"))
        .select("conv_id", "turn", "p.parent_conv", "p.parent_turn", F.col("p.n").alias("n_matches"))
    )


def roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of the linked messages, by pointer doubling."""
    at = store(links.select("conv_id", "turn", F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "chains")
    while True:
        up = at.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("c"), F.col("root_turn").alias("t"), F.col("depth").alias("d"))
        both = at.join(up, ["root_conv", "root_turn"], "left")
        new = store(
            both.select(
                "conv_id", "turn", F.coalesce("c", "root_conv").alias("root_conv"), F.coalesce("t", "root_turn").alias("root_turn"),
                (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("c").isNotNull().alias("moved"),
            ), "chains",
        )
        at = new.drop("moved")
        if new.filter("moved").isEmpty():
            return at


def conversations(messages: DataFrame) -> DataFrame:
    """One row a message, in reply order: (thread_conv, root_turn, depth, conv_id, turn, role, body, parent_conv, parent_turn,
    n_matches, n_quotes, max_level)."""
    rows = parsed(messages)
    known = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    # Repeated rows of a message count once; texts that differ stay.
    once = known.distinct()
    table = store(once.unionByName(rows.filter("conv_id IS NULL OR turn IS NULL")), "messages")
    links = store(parents(table), "reply-links")
    out = table.drop("units").join(links, ["conv_id", "turn"], "left").join(roots(links), ["conv_id", "turn"], "left")
    out = out.select(
        F.coalesce("root_conv", "conv_id").alias("thread_conv"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        "conv_id", "turn", "role", "body", "parent_conv", "parent_turn", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "n_quotes", "max_level",
    )
    key = ["thread_conv", "root_turn", "depth", "conv_id", "turn"]
    return out.repartitionByRange(*key).sortWithinPartitions(*key)


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
