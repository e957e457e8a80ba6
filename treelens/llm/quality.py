"""Quality rules: base rules, and the likelihood ratio of a trusted target against the raw corpus.

Words and pairs of neighbouring words are hashed into ``buckets``.  Two
multinomials over the buckets are counted: the raw one over all documents, the
target one over trusted documents.  A document's score is the mean, over its
n-grams, of log p_target - log p_raw; a document at or above a threshold
passes.  The threshold is the one that parts labelled documents best that no
count has trusted.  No document is drawn by chance: the same corpus and labels
give the same verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, let, words

#: Buckets of hashed n-grams; the model is as many numbers, whatever the corpus.
BUCKETS = 10_000
#: Trusted documents are a sample of at most so many documents labelled good, those with the smallest hash of their id.
TRUSTED = 4_000
#: The threshold is fitted on at most so many documents of each label, the good ones among one in HELD_OUT that are never trusted.
FITTED, HELD_OUT = 2_000, 3
#: N-grams a bucket added to both counts.
SMOOTHING = 1.0
MIN_WORDS, REPEAT_PERCENT = 50, 50


def pair_hashes(x: Column) -> Column:
    """Hashes of the pairs of neighbours of an array."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), lambda a, b: F.xxhash64(a, b))


def bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def repeated_words(w: Column, pairs: Column) -> Column:
    """Words inside windows of three words that occur twice or more.

    Windows are compared by hash, which is that of the hashes of their two
    pairs; sorted with their places, equal ones stand side by side.  Texts
    without a repeat, which are most, end at the count.
    """

    def of_hashes(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_placed(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            again = F.filter(s, lambda x, k: same(k, k - 1) | same(k, k + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, of_placed))

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(pair_hashes(pairs), of_hashes))


def base_columns(text: Column, w: Column, pairs: Column) -> dict[str, Column]:
    """The base measures; ``w`` is the array of the text's words, ``pairs`` that of their pairs' hashes."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "")
    return {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(w, pairs),
    }


def labelled_ids(labels: DataFrame, limit: int = TRUSTED, fitted: int = FITTED) -> DataFrame:
    """(doc_id, quality, trusted): the sample of trusted documents, and those of each label that the threshold is fitted on, if any.

    A document with both labels counts as bad.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id")
    held = (F.pmod(order, F.lit(HELD_OUT)) == 0) & F.lit(fitted > 0)
    first = lambda rows, n, trusted: known.where(rows).orderBy(order, "doc_id").limit(n).withColumn("trusted", F.lit(trusted))
    good = F.col("quality") == 1
    return first(good & ~held, limit, 1).union(first(good & held, fitted, 0)).union(first(~good, fitted, 0)).coalesce(1)


def fitted_threshold(scores: list[tuple[float, int]]) -> float:
    """Where (score, quality) part with the least sum of both error rates; of equals the lowest, half way between two scores.

    Without a document of either label nothing can be told apart, and all pass.
    """
    scores = sorted(scores)
    bad, good = sum(q == 0 for _, q in scores), sum(q == 1 for _, q in scores)
    if not bad or not good:
        return -math.inf
    best, at, lost, left = bad * good, -math.inf, 0, bad
    for k, (score, q) in enumerate(scores[:-1]):
        lost, left = lost + q, left - (q == 0)
        if scores[k + 1][0] > score and lost * bad + left * good < best:
            best, at = lost * bad + left * good, (score + scores[k + 1][0]) / 2
    return at


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents, and of the trusted ones."""
    marked = docs.join(F.broadcast(trusted), "doc_id", "left").select(F.coalesce("trusted", F.lit(0)).alias("trusted"), words(F.coalesce("text", F.lit(""))).alias("w"))
    hashes = let(F.col("w"), lambda w: F.concat(F.transform(w, lambda x: F.xxhash64(x)), pair_hashes(w)))
    grams = marked.select("trusted", F.explode(hashes).alias("h")).select("trusted", bucket(F.col("h"), buckets).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))


def log_ratios(counts: DataFrame, buckets: int, smoothing: float = SMOOTHING) -> list[float]:
    """One number a bucket, for the driver: at most ``buckets`` of them."""
    raw, target = [0] * buckets, [0] * buckets
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * buckets
    total_raw, total_target, extra = sum(raw), sum(target), smoothing * buckets
    share = [(r + smoothing) / (total_raw + extra) for r in raw]
    # extra n-grams, spread as the raw ones are, stand in where the target has few
    return [math.log((t + extra * p) / ((total_target + extra) * p)) for t, p in zip(target, share, strict=True)]


def mean_ratio(w: Column, pairs: Column, model: Column, buckets: int) -> Column:
    total = lambda grams, hashed: F.aggregate(grams, F.lit(0.0), lambda acc, x: acc + F.get(model, bucket(hashed(x), buckets)))
    return (total(w, F.xxhash64) + total(pairs, lambda h: h)) / F.greatest(2 * F.size(w) - 1, F.lit(1))


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float | None = None, trusted: int = TRUSTED, fitted: int = FITTED) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    Other columns pass through; input columns of these names are replaced.  A
    null text has no words and fails the base rules.  A document without
    n-grams has score 0.  Labels (doc_id, quality) that are null, absent or
    name no document trust nothing; without any trusted text every score is 0
    and the base rules decide, as they do where the threshold is to be fitted
    and one label is missing.  Rows that repeat a doc_id are judged each.
    """
    spark = docs.sparkSession
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    docs = docs.drop(*names)
    # a written list: the same sample for every task that reads it
    sample = Scratch(spark).write(labelled_ids(labels, trusted, fitted if threshold is None else 0), "labelled")
    ratios = log_ratios(bucket_counts(docs.select("doc_id", "text"), sample.where("trusted = 1").select("doc_id", "trusted"), buckets), buckets)
    model = F.lit(ratios).cast("array<double>")
    if threshold is None:
        fit = docs.select("doc_id", "text").join(F.broadcast(sample.where("trusted = 0")), "doc_id").select("quality", words(F.coalesce("text", F.lit(""))).alias("w"))
        fit = fit.where(F.size("w") >= MIN_WORDS).select(mean_ratio(F.col("w"), pair_hashes(F.col("w")), model, buckets).alias("score"), "quality")
        threshold = fitted_threshold([tuple(r) for r in fit.collect()])

    text = F.coalesce(F.col("text"), F.lit(""))

    def measures(w: Column, pairs: Column) -> Column:
        base = base_columns(text, w, pairs)
        return F.struct(*(base[k].cast("long").alias(k) for k in names[:5]), mean_ratio(w, pairs, model, buckets).alias("score"))

    measured = docs.select(F.struct("*").alias("row"), let(words(text), lambda w: let(pair_hashes(w), lambda pairs: measures(w, pairs))).alias("measures"))
    own = [F.col("row")[c].alias(c) for c in docs.columns] + [F.col("measures")[c].alias(c) for c in (*names[:5], "score")]
    n_words, n_repeat = F.col("measures.n_words"), F.col("measures.n_repeat_words")
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    return measured.select(*own[:-1], failed.alias("base_failed"), own[-1], (~failed & (F.col("measures.score") >= threshold)).alias("kept"))
