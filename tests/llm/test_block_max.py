"""Ranked search against brute force, with blocks and segments of all sizes; packing of postings; odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import block_max
from tests.llm.test_operators import frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best=10):
    """docs, items: (id, text). (item_id, rank, doc_id, score)"""
    counts = [(doc_id, Counter(terms_of(t))) for doc_id, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                scored.append((-s, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, k, row[3], -row[0]) for k, row in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeÉß日") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(words[: rng.choice([5, 50, 400])]) for _ in range(n))
    docs = [text(rng.randint(1, 80)) for _ in range(900)]
    passage = text(40)
    docs += [passage.upper()] * 30 + [f"{passage} {text(5)}" for _ in range(40)] + [None, "", " .,-", "\x00", text(30_000), "x" * 100_000]
    rng.shuffle(docs)
    items = [passage, None, "", "nowhere", *(text(rng.randint(1, 30)) for _ in range(25)), passage]
    return docs, items


@pytest.mark.parametrize(("block", "segment_bytes", "query_bytes"), [(128, 16 << 20, 4 << 20), (4, 9000, 1000), (1, 700, 4 << 20)])
def test_the_best_are_those_of_brute_force(spark, corpus, monkeypatch, block, segment_bytes, query_bytes):
    monkeypatch.setattr(block_max, "BLOCK", block)
    texts, asked = corpus
    ids = [None if k == 3 else k // 2 if k < 40 else k for k in range(len(texts))]  # ids that repeat, and none
    items = [(0 if k == len(asked) - 1 else k, t) for k, t in enumerate(asked)]  # the last item is the first again
    docs, stats = frame(spark, texts, ids), None
    stats = block_max.corpus_stats(docs)
    queries = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, score string")
    # The tasks' modules are their own, so the size of blocks is set here alone: segments are made in this process.
    order = sorted(range(len(texts)), key=lambda k: (ids[k] is not None, ids[k] or 0))
    rows, at = [], 0
    step = max(1, segment_bytes // 300)
    for at in range(0, len(order), step):
        own = order[at : at + step]
        made = block_max.segment(np.array([block_max._NO_ID if ids[k] is None else ids[k] for k in own], np.int64), pa.array([texts[k] or "" for k in own]), stats)
        rows.append(tuple(bytearray(made[c].tobytes()) for c in block_max.COLUMNS))
    found = block_max.search(spark.createDataFrame(rows, block_max.INDEX), stats, queries, query_bytes=query_bytes) if block == 128 else None
    want = brute(list(zip(ids, texts, strict=True)), items)
    if found is not None:
        assert sorted(map(tuple, found.collect()), key=str) == want
    local = []
    for item_id, text in set(items):
        names = sorted({t.encode() for t in terms_of(text)})
        segments = [block_max.Segment(pa.RecordBatch.from_arrays([pa.array([bytes(v)], pa.binary()) for v in row], names=list(block_max.COLUMNS)), names) for row in rows]
        df = {t: sum(s.df(s.number[t]) for s in segments if t in s.number) for t in range(len(names))}
        hits = []
        for s in segments:
            plan = [(s.number[t], stats.weight(df[t])) for t in range(len(names)) if t in s.number and stats.weight(df[t])]
            hits += [(-score, (d := s.doc_id(doc)) is not None, d or 0, d) for score, doc in block_max.best_of_segment(s, plan, 1, 10)]
        local += [(item_id, k, row[3], -row[0]) for k, row in enumerate(sorted(hits)[:10], 1)]
    assert sorted(local, key=str) == want


def test_ranked_over_tasks_and_segments(spark, corpus):
    texts, asked = corpus
    docs = frame(spark, texts).repartition(7)
    queries = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    found = block_max.ranked(docs, queries, segment_bytes=20_000)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(list(enumerate(texts)), list(enumerate(asked)))


def test_blocks_are_skipped_unopened():
    rng = random.Random(2)
    texts = [" ".join(["the", *(rng.choice("abcdefgh") for _ in range(9))]) for _ in range(20_000)]
    for k in (15_000, 15_001, 15_002):
        texts[k] = "the rare one the"
    flat_n = sum(len(t.split()) for t in texts)
    stats = block_max.Stats(len(texts), flat_n)
    made = block_max.segment(np.arange(len(texts)), pa.array(texts), stats)
    own = block_max.Segment(pa.RecordBatch.from_arrays([pa.array([made[c].tobytes()], pa.binary()) for c in block_max.COLUMNS], names=list(block_max.COLUMNS)), [b"rare", b"one", b"the", b"a"])
    weights = [stats.weight(own.df(own.number[k])) for k in range(4)]
    plan = [(own.number[k], max(1, w)) for k, w in enumerate(weights)]
    hits = block_max.best_of_segment(own, plan, 1, 3)
    assert sorted(d for _, d in hits) == [15_000, 15_001, 15_002]
    # "the" has 157 blocks and "a" over a hundred; only those at the start, before the threshold stands, and near the hits were unpacked.
    assert len(own._kept) < 40


def test_empty_tables(spark):
    docs, none = frame(spark, ["a b", "b"]), spark.createDataFrame([], "item_id long, text string")
    queries = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert block_max.ranked(docs, none).collect() == []
    assert block_max.ranked(frame(spark, []), queries).collect() == []
    assert block_max.ranked(frame(spark, [None, "..", ""]), queries).collect() == []
