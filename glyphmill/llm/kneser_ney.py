"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of words.

The model (``word_ngrams``) has an open vocabulary and is trained on all trusted text: the
documents that labels mark as good and not toxic.

* Training: on all trusted documents but those held out; n-grams are counted per
  slice, summed in shards of their last two words, and the orders below count distinct left extensions. The three discounts of each order come from its counts of
  counts, probabilities from joins with the totals of contexts and the next lower order.
* Scoring: the n-grams of all texts are joined with one part of the table after the other, in
  shards of hashes, and added up per text, which gives the perplexity per word.
* Decision: one trusted document in FOLDS is kept out of training. A document goes if its
  perplexity is over the quantile HIGH of those and of all trusted ones, or under the quantile
  LOW of all trusted ones, in its language. At all sizes the logs of a language's limits are weighted by its n
  held-out documents with those of all languages, which weigh as much as PRIOR documents.

Edges: a text without words (null, empty or blank) has a null perplexity and is
rejected; a language without trusted documents (or null) takes the quantiles of
all trusted documents; with no trusted document at all everything with text is
kept; a doc_id that is labelled repeatedly is trusted if no label speaks against
it; repeated rows are scored alike; an empty table gives no row; other columns
pass through ``keep_good`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import word_ngrams
from glyphmill.llm.common import discard, documents, store, text_or_empty

LOW, HIGH, ACCURACY = 0.001, 0.99, 20_000
FOLDS, PRIOR = 5, 20


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The discounts of counts 1, 2 and 3 or more, from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents that every label of theirs calls good and none toxic."""
    good = (F.coalesce(labels["quality"], F.lit(0)) == 1) & (F.coalesce(labels["toxic"], F.lit(0)) == 0)
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id"), good.alias("good")).filter("doc_id IS NOT NULL")
    return ids.groupBy("doc_id").agg(F.bool_and("good").alias("good")).filter("good").select("doc_id")


def held_out(ids: DataFrame, out: bool) -> DataFrame:
    """The trusted documents that calibrate (out) or train."""
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    return ids.filter(fold if out else ~fold)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text) of all trusted documents that train."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return texts.join(held_out(trusted_ids(labels), False), "doc_id", "left_semi")


def thresholds(scores: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(lang, lo, hi, n), n the held-out trusted documents of each language; the row of a null language is that of all.

    scores: (doc_id, lang, perplexity)."""
    ids = trusted_ids(labels).select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("out"))
    trusted = scores.filter("perplexity IS NOT NULL").join(ids.hint("merge"), "doc_id")
    # Texts that trained, and copies of theirs, are likelier than others, so the lower limit is that of all trusted ones; the
    # upper one is over both quantiles, as a few held-out texts say little of how unlikely trusted ones get.
    lo, hi = F.percentile_approx("perplexity", low, ACCURACY), F.percentile_approx(F.when(F.col("out"), F.col("perplexity")), high, ACCURACY)
    ends = [lo.alias("lo"), F.greatest(hi, F.percentile_approx("perplexity", high, ACCURACY)).alias("hi"), F.count_if("out").alias("n")]
    own = trusted.filter("lang IS NOT NULL").groupBy("lang").agg(*ends)
    every = trusted.agg(*ends).select(F.lit(None).cast("string").alias("lang"), "lo", "hi", "n")
    return own.unionByName(every).select("lang", "lo", "hi", "n")


def judged(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds _gm_lo, _gm_hi and _gm_kept to rows of (lang, perplexity, ...). limits has a row a language."""
    rows = limits.collect()
    least, most = next(((r["lo"], r["hi"]) for r in rows if r["lang"] is None), (None, None))

    def drawn(own: float, every: float, n: int) -> float:
        return math.exp((n * math.log(own) + PRIOR * math.log(every)) / (n + PRIOR))

    table = {r["lang"]: (drawn(r["lo"], least, r["n"]), drawn(r["hi"], most, r["n"])) for r in rows if r["lang"] is not None}
    every = F.array(F.lit(least).cast("double"), F.lit(most).cast("double"))
    if table:
        own = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(e).cast("double") for e in v]))])
        every = F.coalesce(F.when(F.col("lang").isNotNull(), own[F.col("lang")]), every)
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity").between(F.col("_gm_ends")[0], F.col("_gm_ends")[1]), F.lit(True))
    return (
        scores.withColumn("_gm_ends", every)
        .withColumn("_gm_lo", F.col("_gm_ends")[0])
        .withColumn("_gm_hi", F.col("_gm_ends")[1])
        .withColumn("_gm_kept", kept)
        .drop("_gm_ends")
    )


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, perplexity): of each distinct text, by its xxhash64, under the model of the trusted texts."""
    texts = store(trusted_texts(docs, labels), "trusted")
    counts = word_ngrams.counted(texts, word_ngrams.shard_bits(texts))
    discard(texts)
    rows = docs.select(F.xxhash64(text_or_empty(docs)).alias("key"), text_or_empty(docs).alias("text"))
    base, tables = word_ngrams.tables(counts)
    sums, size = [], word_ngrams.length(rows)
    for k, table in enumerate(tables):
        sums.append(word_ngrams.sums(rows, size, table, k, word_ngrams.TRAIN_PASSES))
        discard(table)  # all parts are larger than the texts
    return word_ngrams.perplexity(sums, base)


def _with_scores(docs: DataFrame, scores: DataFrame) -> DataFrame:
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), F.xxhash64(text_or_empty(docs)).alias("key"))
    return narrow.join(scores, "key", "left").select("doc_id", "lang", "perplexity")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, perplexity, low, high, kept) of every document."""
    scores = store(_with_scores(docs, scored(docs, labels)), "scores")
    return judged(scores, thresholds(scores, labels)).select(
        "doc_id", "lang", "perplexity", F.col("_gm_lo").alias("low"), F.col("_gm_hi").alias("high"), F.col("_gm_kept").alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the documents that the classifier rejects."""
    scores = scored(docs, labels)
    limits = thresholds(_with_scores(docs, scores), labels)
    keyed = docs.withColumn("_gm_key", F.xxhash64(text_or_empty(docs))).withColumnRenamed("perplexity", "_gm_other")
    view = judged(keyed.join(scores.withColumnRenamed("key", "_gm_key"), "_gm_key", "left"), limits)
    return view.filter("_gm_kept").drop("perplexity").withColumnRenamed("_gm_other", "perplexity").select(docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
