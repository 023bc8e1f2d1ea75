"""The quality classifier: its word model against the definition, and what it keeps."""

import random
from collections import Counter
from itertools import chain

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import kneser_ney, word_ngrams

from .test_operators import frame


def test_word_model_by_its_definition(spark):
    rng = random.Random(4)
    vocabulary = [*"abcdefgh", "Über", "слово", "λέξη", "42", "語"]
    train = [" ".join(rng.choice(vocabulary[: rng.randint(2, 13)]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    asked = [*train[:5], "a b новое a", "слово слово 語語", "x" * 50, "a", "", " \n", None, "a b новое a"]
    table, base = word_ngrams.train(frame(spark, train))
    keyed = frame(spark, asked).select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    got = {r.key: r.perplexity for r in word_ngrams.perplexities(keyed, table, base).collect()}
    tables = {3: {}}
    padded = [["<", "<", *word_ngrams.WORD.findall(t), ">"] for t in train]
    for s in padded:
        for k in range(len(s) - 2):
            g = tuple(s[k : k + 3])
            tables[3][g] = tables[3].get(g, 0) + 1
    for n in (2, 1):
        tables[n] = {}
        for g in tables[n + 1]:
            tables[n][g[1:]] = tables[n].get(g[1:], 0) + 1
    d = {n: kneser_ney.discounts([sum(v == k for v in t.values()) for k in (1, 2, 3, 4)]) for n, t in tables.items()}

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(tables[1]) + 1)
        mates = [v for k, v in tables[n].items() if k[:-1] == g[:-1]]
        own = tables[n].get(g, 0)
        if not mates:
            return p(g[1:])
        return (own - (d[n][min(own, 3) - 1] if own else 0) + sum(d[n][min(v, 3) - 1] for v in mates) * p(g[1:])) / sum(mates)

    for r in keyed.collect():
        words = word_ngrams.WORD.findall(r.text)
        s = ["<", "<", *words, ">"]
        want = float(np.exp(-np.mean([np.log(p(tuple(s[k : k + 3]))) for k in range(len(s) - 2)]))) if words else None
        assert got.get(r.key) == (None if want is None else pytest.approx(want, rel=1e-9))


def test_quality_reads_words_of_all_scripts(spark):
    rng = random.Random(6)
    said = {"en": "the quick cat sat down on that old mat while my dog slept under our table".split(), "ru": "кот сидел на старом ковре пока моя собака спала под нашим столом днём".split()}
    def prose(w):
        return " . ".join(" ".join(w[k:] + w[:k]) for k in [rng.randrange(len(w)) for _ in range(6)])
    rows = [(k, prose(said[lang]), lang) for k, lang in enumerate(["en", "ru"] * 60)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(rows))], "doc_id long, quality int, toxic int")
    shuffled = [(1000 + k, " ".join(rng.sample(t.split(), len(t.split()))), lang) for k, t, lang in rows[:20]]
    noise = [(2000 + k, " ".join("".join(rng.choice("бвгджзклмн") for _ in range(5)) for _ in range(70)), "ru") for k in range(10)]
    docs = spark.createDataFrame(rows + shuffled + noise, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in kneser_ney.classify(docs, labels).filter("kept").collect()}
    assert len([k for k in kept if k < 1000]) >= 115 and not [k for k in kept if k >= 1000]


def test_limits_do_not_switch_on_size(spark):
    scores = spark.createDataFrame([(p, "fr", 10.0 * p) for p in range(1, 61)], "doc_id long, lang string, perplexity double")

    def limits(n):
        rows = [("fr", 100.0, 300.0, n), (None, 50.0, 500.0, 5 * n)]
        got = kneser_ney.judged(scores, spark.createDataFrame(rows, "lang string, lo double, hi double, n long")).select("_gm_lo", "_gm_hi").first()
        return np.array(tuple(got))

    assert np.allclose(limits(199), limits(201), rtol=0.01) and np.allclose(limits(10**6), [100, 300], rtol=0.01)
    ends = [limits(n) for n in (1, 10, 100, 1000)]
    assert all(a[0] < b[0] and a[1] > b[1] for a, b in zip(ends, ends[1:]))


def test_limits_are_the_quantiles_themselves(spark):
    n = 2000
    scores = spark.createDataFrame([(k, "en", float(k + 1)) for k in range(n)], "doc_id long, lang string, perplexity double")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(n)], "doc_id long, quality int, toxic int")
    out = {r.doc_id for r in kneser_ney.held_out(kneser_ney.trusted_ids(labels), True).collect()}
    r = kneser_ney.thresholds(scores, labels).filter("lang = 'en'").first()
    assert r.n == len(out) and r.lo <= 0.0015 * n and sum(k + 1 > r.hi for k in out) == pytest.approx(0.01 * len(out), abs=1)


def test_few_bad_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = kneser_ney.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").select("quality", "kept").collect()
    bad, good = ([r.kept for r in got if r.quality == q] for q in (0, 1))
    assert sum(bad) <= 0.25 * len(bad) and sum(good) >= 0.97 * len(good)


def test_what_texts_send_grows_in_proportion(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]

    def texts(n):
        rows = [(k, " ".join(rng.choice(words) for _ in range(400))) for k in range(n)]
        return spark.createDataFrame(rows, "key long, text string").coalesce(1)

    table, base = word_ngrams.train(texts(200))
    known, bits = spark.sparkContext.broadcast(word_ngrams.known_filter(table)), word_ngrams.table_bits(table)
    sizes = []
    for n in (1000, 8000):
        sent = word_ngrams.dealt(texts(n), bits, 1, known)
        sizes.append(sent.agg(*[F.sum(F.octet_length(c)) for c in ("hashes", "keys", "words")], F.count("*")).first())
    small, large = sizes
    # Keys and numbers of words go once; rows are as many a slice as there are shards.
    assert small[1] == 8 * 1000 and large[1] == 8 * 8000 and large[2] == 8 * 8000
    assert large[3] <= 8 * small[3] and large[0] <= 8.5 * small[0]


def test_copies_of_shards_and_passes_change_nothing(spark, monkeypatch):
    rng = random.Random(10)
    words = [*"abcdefgh", "語", "слово"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    frame_ = spark.createDataFrame(rows, "key long, text string").repartition(5)
    table, base = word_ngrams.train(frame_.filter("key % 3 = 0"))
    want = {r.key: r.perplexity for r in word_ngrams.perplexities(frame_, table, base).collect()}
    monkeypatch.setattr(word_ngrams, "GROUP_BYTES", 64)
    got = {r.key: r.perplexity for r in word_ngrams.perplexities(frame_, table, base, 3).collect()}
    assert len(want) == 400 and got.keys() == want.keys()
    assert all((got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, rel=1e-12)) for k, v in want.items())


def test_all_trusted_documents_train(spark):
    n = 12_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    held = {r.doc_id for r in kneser_ney.held_out(kneser_ney.trusted_ids(labels), True).collect()}
    assert {r.doc_id for r in kneser_ney.trusted_texts(docs, labels).collect()} == set(range(n)) - held and n - len(held) > 9000


def test_a_frequent_word_lies_in_many_shards(spark):
    words = [f"w{k}" for k in range(400)]
    texts = frame(spark, [" . ".join(words[k:] + words[:k]) for k in range(20)])
    counts = word_ngrams.counted(texts, 5)
    shards = {r.shard: np.frombuffer(r.b, np.uint64) for r in counts.select("shard", "b").collect()}
    dot = word_ngrams._HASHES["."]
    assert sum(dot in b for b in shards.values()) == len(shards) == 32


def test_filters_of_all_passes_and_shards(spark, monkeypatch):
    texts = frame(spark, [" ".join(f"w{k * j % 997}" for j in range(300)) for k in range(1, 40)])
    want, base = word_ngrams.train(texts)
    monkeypatch.setattr(word_ngrams, "TABLE_SHARD", 16 << 10)
    got, other = word_ngrams.train(texts)
    assert base == other and word_ngrams.table_bits(want) == 4 and word_ngrams.table_bits(got) > 4

    def values(table):
        rows = table.collect()
        assert max(Counter(r["shard"] for r in rows).values()) <= word_ngrams.TRAIN_PASSES  # a row a shard and pass
        h, v = (np.concatenate([np.frombuffer(bytes(r[c]), t) for r in rows]) for c, t in (("hashes", np.uint64), ("values", np.float64)))
        assert len(np.unique(h)) == len(h)
        return dict(zip(h.tolist(), v.tolist()))

    assert values(want) == pytest.approx(values(got), rel=1e-12)
    assert word_ngrams.known_filter(want) == word_ngrams.known_filter(got)


def test_the_table_goes_when_texts_are_scored(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a b w{k % 7} c", "en") for k in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    gone, discard = [], kneser_ney.discard
    monkeypatch.setattr(kneser_ney, "discard", lambda t: (gone.append(t.columns), discard(t)))
    assert kneser_ney.keep_good(docs, labels).count() > 30 and ["shard", "hashes", "values"] in gone


def test_one_part_of_the_table_is_there_at_a_time(spark, monkeypatch):
    rng = random.Random(12)
    docs = spark.createDataFrame([(k, " ".join(rng.choice("abcdefgh") for _ in range(30)), "en") for k in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    there, most, stored, discard = [], [], word_ngrams.store, kneser_ney.discard

    def store(df, name, *more):
        there.extend([name] * (name == "ngram-values"))
        most.append(len(there))
        return stored(df, name, *more)

    def gone(table):
        del there[: len({f.rsplit("/", 2)[1] for f in table.inputFiles()})]
        discard(table)

    table, base = word_ngrams.train(kneser_ney.trusted_texts(docs, labels))
    keyed = docs.select(F.xxhash64("text").alias("key"), "text")
    want = {r.key: r.perplexity for r in word_ngrams.perplexities(keyed, table, base).collect()}
    monkeypatch.setattr(word_ngrams, "store", store)
    monkeypatch.setattr(kneser_ney, "discard", lambda t: gone(t) if "hashes" in t.columns else discard(t))
    got = {r.key: r.perplexity for r in kneser_ney.scored(docs, labels).collect()}
    assert max(most) == 1 and not there and len(got) == 60 and got == pytest.approx(want, rel=1e-12)


def test_counts_take_few_bytes(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    counts = word_ngrams.counted(frame(spark, [" ".join(rng.choice(words) for _ in range(500)) for _ in range(60)]), 3)
    rows = counts.collect()
    held = sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray)))
    runs = sum(int(np.frombuffer(bytes(r["size"]), np.uint32).sum()) for r in rows)
    assert runs > 25_000 and held < 16 * runs


def test_words_are_those_of_the_pattern():
    rng = random.Random(14)
    letters = [*"abZ09_ \n\t.,!?éüß語กက слово'\"-\x00\x1c", "\u3000", "\u00a0", "\u2028", "\U00020000", "😀"]
    for _ in range(200):
        texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 50]))) for _ in range(rng.randint(0, 6))]
        found = [word_ngrams.WORD.findall(t) for t in texts]
        words, of = word_ngrams._slice(texts)
        want = [[word_ngrams.START] * 2 + [word_ngrams._HASHES[w] for w in f] + [word_ngrams.END] if f else [] for f in found]
        assert words.tolist() == list(chain.from_iterable(want)) and of.tolist() == [k for k, w in enumerate(want) for _ in w]
