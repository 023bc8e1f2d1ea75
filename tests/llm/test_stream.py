"""Packing that follows the mixed stream, from files."""

import random

from glyphmill.llm import packing, pfair, tokens
from glyphmill.llm.common import write_table


def prefix_shares(rows, of, size):
    """The largest distance of a source's share of tokens in the first tenths of sequences from its share in all."""
    ids = sorted({r.sequence_id for r in rows})
    worst, total = 0.0, sum(r.length for r in rows)
    for part in range(2, size):
        first = [r for r in rows if r.sequence_id <= ids[len(ids) * part // size - 1]]
        n = sum(r.length for r in first)
        for s in set(of.values()):
            worst = max(worst, abs(sum(r.length for r in first if of[r.doc_id] == s) / n - sum(r.length for r in rows if of[r.doc_id] == s) / total))
    return worst


def test_sequences_follow_the_mix(spark):
    rng = random.Random(3)
    # The two sources' documents come one after the other; the weights take both up together.
    rows = [(k, " ".join("ab" for _ in range(rng.randint(20, 200))), "a" if k < 1000 else "b") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).sortWithinPartitions("doc_id")
    of = {d: s for d, _, s in rows}
    options = {"weights": {"a": 0.5, "b": 0.5}, "block": 4}
    mixed = packing.pack_stream(write_table(pfair.mix(docs, **options), "mixed"), tokens.vocabulary()).collect()
    plain = packing.pack_stream(write_table(docs, "plain"), tokens.vocabulary()).collect()
    assert len({r.sequence_id for r in mixed}) == len({r.sequence_id for r in plain})
    a, b = prefix_shares(mixed, of, 10), prefix_shares(plain, of, 10)
    assert a < 0.05 and b > 0.1
    assert packing.pack_stream(docs.limit(0), tokens.vocabulary()).count() == 0


def test_spread_keeps_every_sequence():
    plan = [((5, 3), 700), ((8,), 1), ((2, 2, 2), 63), ((1,), 65)]
    for stretches in (1, 7, 64):
        got = {}
        for lengths, n in packing.spread(plan, stretches):
            got[lengths] = got.get(lengths, 0) + n
        assert got == dict(plan)
