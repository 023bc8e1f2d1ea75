"""Cuts and forms against a regular expression, exact round trips, odd rows."""

import hashlib
import random
import re

from glyphmill.llm import fill_in_middle as fim
from tests.llm.test_operators import frame

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PARTS = [" ", "\t\n", "\x0b", "\x0c\r", "a", "bc", "é", "日本", "𝒜", "\x1c", "\x85", " ", "<", "<P", "<S", ">", "<P>", "<M>", "\0"]


def some_texts(n, seed, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS[:-3] if k % 3 else PARTS) for _ in range(rng.randint(0, most))) for k in range(n)]


def expected(text, doc_id):
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_token_ends_and_ranked_bits():
    for text in some_texts(800, 1):
        data, at, want = text.encode(), 0, []
        for unit in UNIT.findall(text):
            at += len(unit.encode())
            want.append(at - 1)
        ends = fim.token_ends(data)
        assert ends.bit_count() == len(want)
        assert [fim.ranked_bit(ends, len(data), k) for k in range(1, len(want) + 1)] == want
        assert fim.code_points(data) == len(text)


def test_report_and_round_trip(spark):
    texts = [None, "", " ", "a", *some_texts(300, 2), "a b" * 100_000, " " * 50_000 + "x"]
    ids = [None, *range(1, len(texts) - 1), 5]
    docs = frame(spark, texts, ids)
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    want = []
    for doc_id, text in zip(ids, texts, strict=True):
        n, form, p, m, output = expected(text or "", doc_id)
        want.append((doc_id, n, form, p, m, digest(output), digest(text or "")))
    rows = [tuple(r) for r in fim.report(docs).collect()]
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    made = fim.transform(docs)
    assert made.columns == [*docs.columns, "_gm_form"]
    assert sorted(digest(r.text) for r in made.collect()) == sorted(w[5] for w in want)
    back = fim.restore(made)
    assert back.columns == docs.columns
    assert sorted(map(tuple, back.collect()), key=key) == sorted(((*r[:1], r[1] or "", *r[2:]) for r in map(tuple, docs.collect())), key=key)


def test_empty_table(spark):
    assert fim.report(frame(spark, [])).collect() == [] and fim.transform(frame(spark, [])).collect() == []
