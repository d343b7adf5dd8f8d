"""Quality rules in SQL functions: plain counts, and a log-likelihood ratio of hashed n-grams.

The ratio compares two multinomials over hashed words and pairs of neighbouring words: one of trusted documents, one of the raw corpus. A
document's score is the sum of log(p_trusted / p_raw) over its n-grams, divided by their number. A document is kept when no
base rule fails and its score is at least ``least``: no draw, the same verdict in every run.

Raw counts cover all documents. Trusted ones are at most ``max_trusted`` labelled documents, those with the least hashes of
their ids. All n-grams fall into ``buckets`` places, so the table that scores everything has a fixed size.

Null texts count as empty: no words, base failed, not kept. Without trusted documents all scores are 0. Rows with repeated ids are judged each.

Texts of any length are read whole, an empty table gives an empty one, and columns other than key and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 14
MAX_TRUSTED = 20_000
#: Natural log units per n-gram.
LEAST = -0.055
MIN_WORDS = 50
#: Percent of the words that may stand in repeated windows.
MAX_REPEATED = 50
#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
_GAP = "[\\x20\\x09-\\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once per row although inner functions name it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column, n: int) -> Column:
    """Hashes of the runs of n words."""
    def made(w: Column) -> Column:
        runs = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.transform(runs, lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(n)]))
                      ).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    return _let(words, made)


def repeated_words(windows: Column, n: int) -> Column:
    """How many words stand in windows of n words that occur more than once: equal hashes lie side by side once sorted."""
    def covered(pairs: Column) -> Column:
        def equal(a: Column, b: Column) -> Column:
            return F.coalesce(F.get(pairs, a)["h"] == F.get(pairs, b)["h"], F.lit(False))

        index = F.sequence(F.lit(0), F.size(pairs) - 1)
        places = F.transform(F.filter(index, lambda k: equal(k, k - 1) | equal(k, k + 1)), lambda k: F.get(pairs, k)["i"])
        spans = F.flatten(F.transform(places, lambda p: F.sequence(p, p + (n - 1))))
        return F.when(F.size(pairs) > 0, F.size(F.array_distinct(spans))).otherwise(0)

    def search(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), _let(pairs, covered)).otherwise(0)

    return _let(windows, search)


def base_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("__text")).withColumn("words", _words(F.col("__text")))
    rows = rows.withColumn("__three", _windows(F.col("words"), 3)).withColumn("__lines", lines)
    gaps = F.length(F.translate(F.col("__text"), " \t\n\x0b\x0c\r", ""))
    counted = rows.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), gaps.cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate(F.col("__text"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__three"), 3).cast("long").alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                              | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def _places(words: Column, buckets: int) -> Column:
    """Buckets of all words and pairs of neighbours."""
    grams = _let(words, lambda w: F.concat(F.transform(w, lambda x: F.xxhash64(x)), _windows(w, 2)))
    return F.transform(grams, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
           max_trusted: int = MAX_TRUSTED) -> list[float]:
    """log(p_trusted / p_raw) per bucket, with one added to every count."""
    sample = (trusted.select(F.col(key).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).withColumn("hit", F.lit(1)))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), _places(_words(F.col(text).cast("string")), buckets).alias("places"))
    # at most max_trusted ids of 16 bytes
    marked = rows.join(F.broadcast(sample), "doc_id", "left").select(F.explode("places").alias("place"), "hit")
    counts = marked.groupBy("place").agg(F.count("*").alias("raw"), F.count("hit").alias("good")).collect()
    raw, good = np.ones(buckets), np.ones(buckets)
    for place, r, g in counts:  # one row per bucket at most
        raw[place] += r
        good[place] += g
    if good.sum() == buckets:
        return [0.0] * buckets
    return (np.log(good / good.sum()) - np.log(raw / raw.sum())).tolist()


def judged(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST,
           buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept)."""
    table = F.lit(np.array(ratios(docs, trusted, key, text, buckets, max_trusted)))
    rows = base_counts(docs, key, text).withColumn("__places", _places(F.col("words"), buckets))
    total = F.aggregate("__places", F.lit(0.0), lambda s, p: s + F.get(table, p))
    ratio = F.when(F.size("__places") > 0, total / F.size("__places")).otherwise(0.0)
    return rows.withColumn("ratio", ratio).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least)).drop("words", "__places")
