"""Token counts of prefixes against the library, on strings made to break cuts and on whole tables."""

import random

import pytest
import sentencepiece

from glyphmill.llm import prefix_tokens
from tests.llm.test_operators import frame

PARTS = [" ", "  ", "\n", " \n", "\t", "▁", "\0", "a", "b", "e", "n", "th", "ing", "the", "é", "é", "日", "本", "𝒜", "-", "=", "__", "1", "<s>", "<0x0A>", "x" * 20, " " * 20]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=prefix_tokens.vocabulary())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n", "hello hell", "a", "a"]
    out += ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    return [*out, " ".join("".join(rng.choice(PARTS) for _ in range(3)) for _ in range(9000)), "ab" * 4000, "日本" * 3000]


def test_every_prefix_is_the_library_s(library):
    rng, own = random.Random(4), prefix_tokens.counter(prefix_tokens.vocabulary())
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    for text, steps in zip(texts, own.packed(texts), strict=True):
        assert prefix_tokens._unpacked(steps).tolist() == [len(library.encode(text[:k])) for k in range(len(text) + 1)], repr(text)


def test_tables_that_forget_give_the_same(library, monkeypatch):
    monkeypatch.setattr(prefix_tokens, "_MOST_CUTS", 20)
    monkeypatch.setattr(prefix_tokens, "_MOST_PAIRS", 50)
    monkeypatch.setattr(prefix_tokens, "_CACHE_BITS", 4)
    rng, own = random.Random(5), prefix_tokens.PrefixCounter(prefix_tokens.vocabulary())
    for _ in range(20):
        texts = ["".join(rng.choice(PARTS) for _ in range(30)) for _ in range(10)]
        assert [int(prefix_tokens._unpacked(s)[-1]) for s in own.packed(texts)] == list(map(len, library.encode(texts)))


def test_totals_fits_and_questions(spark, texts, library):
    docs = frame(spark, texts, [*range(len(texts) - 1), 0])
    table = prefix_tokens.prefix_table(docs)
    limit = 40
    want = []
    for doc_id, text in zip([*range(len(texts) - 1), 0], texts, strict=True):
        text = text or ""
        n = len(library.encode(text))
        # Far beyond the limit no prefix is within it, as a token has 16 characters at most.
        ends = [k for k in range(min(len(text), 20 * limit) + 1) if len(library.encode(text[:k])) <= limit]
        want.append((doc_id, len(text.encode()), n, max(ends)))
    assert sorted(map(tuple, prefix_tokens.fits(table, limit).collect())) == sorted(want)
    assert sorted(map(tuple, prefix_tokens.totals(table).collect())) == sorted(w[:3] for w in want)
    asked = spark.createDataFrame([(7, 5), (7, 10**9), (7, -1), (7, None), (None, 1), (10**6, 1), (4, 10)], "doc_id long, chars long")
    said = prefix_tokens.tokens_at(table, asked).collect()
    seven = texts[7]
    assert sorted(map(tuple, said), key=str) == sorted(
        [(7, 5, len(library.encode(seven[:5]))), (7, 10**9, len(library.encode(seven))), (7, -1, 0), (7, None, None), (4, 10, len(library.encode(texts[4][:10])))], key=str
    )


def test_truncated_texts_fit(spark, texts, library):
    docs = frame(spark, texts)
    cut = prefix_tokens.truncated(docs, prefix_tokens.prefix_table(docs), 30)
    assert cut.columns == docs.columns
    rows = {r.doc_id: r.text for r in cut.collect()}
    assert len(rows) == len(texts) and rows[0] is None
    for doc_id, text in enumerate(texts[1:], 1):
        assert text.startswith(rows[doc_id]) and len(library.encode(rows[doc_id])) <= 30
        assert rows[doc_id] == text or len(library.encode(text[: len(rows[doc_id]) + 1])) > 30


def test_empty_table(spark):
    assert prefix_tokens.fits(prefix_tokens.prefix_table(frame(spark, []))).collect() == []


def test_query_on_the_whole_table(spark, library):
    rows = prefix_tokens.op12_tokencounts(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {d.doc_id: (len((d.text or "").encode()), len(library.encode(d.text or ""))) for d in docs}
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want and all(r.over_limit == (r.n_tokens > 4096) for r in rows)
