"""Quality rules: repetition counts, and a hashed n-gram likelihood ratio between trusted and raw text.

Everything is columns over one row's arrays, and no document meets another one. The trusted multinomial comes from all
documents labelled good, the raw one from all documents, both over `buckets` hashed word unigrams and as many bigrams.
Ids labelled good are broadcast where there are at most `most_broadcast`, so texts stay where they are; beyond that texts
meet their labels by one shuffle on doc_id, in which rows without id are one key. Else only bucket counts travel. A document's score is its
mean log ratio per n-gram; it is kept when that is at least `least`, and no base rule failed. Equal windows
are told by 64-bit hashes within a document.

Defined cases: null and empty text have no words and fail the base rule; without any labelled row the ratio is 0 for
every n-gram, so base rules alone decide; long texts are handled whole (arrays of one long per word); rows that repeat a
doc_id count each, in the raw and, where the id is labelled good, in the trusted counts; a ratio of just `least` is
kept, and equal texts get equal verdicts; an empty table gives an empty result; extra columns, whatever their names, are
left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import SPACE_CHARS, SPACES, sent_whole

WINDOW = 8


def word_list(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+"))


def windows(hashes: Column, n: Column, size: int) -> Column:
    """A hash for each run of size words."""
    runs = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(hashes, i, size)))
    return F.when(n >= size, runs).otherwise(F.array().cast("array<bigint>"))


def with_covered(df: DataFrame, wins: str, when: str, size: int, out: str) -> DataFrame:
    """Adds the number of words that lie in windows found more than once: once sorted, equal windows are neighbours.

    A column for each step: an expression named inside a lambda would be worked out again for each element.
    """
    order = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, j: F.coalesce(F.get("__order", j)["h"] == x["h"], F.lit(False))
    found = F.filter("__order", lambda x, j: same(x, j - 1) | same(x, j + 1))
    at = F.sort_array(F.transform("__found", lambda x: x["i"]))
    widths = F.transform("__at", lambda i, j: F.least(F.lit(size), F.coalesce(F.get("__at", j + 1) - i, F.lit(size))))
    total = F.aggregate("__widths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    for name, step in (("__order", order), ("__found", found), ("__at", at), ("__widths", widths)):
        df = df.withColumn(name, F.when(F.col(when), step))
    return df.withColumn(out, F.when(F.col(when), total).otherwise(F.lit(0).cast("bigint")))


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hashes)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    one = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), word_list(F.col(text)).alias("words"), lines.alias("lines"))
    two = one.select(
        "doc_id",
        F.size("words").alias("n"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    three = two.withColumn("wins", windows(F.col("hashes"), F.col("n"), WINDOW))
    four = three.withColumn("repeats", F.size(F.array_distinct("wins")) < F.size("wins"))
    five = with_covered(four, "wins", "repeats", WINDOW, "n_repeat_words")
    return five.select("doc_id", F.col("n").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "hashes")


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """The buckets of a row's word unigrams, and beyond those of its bigrams, so that neither blurs the other's counts."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    after = F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.concat(single, F.transform(after, lambda h, i: (F.pmod(F.xxhash64(h, F.get(hashes, i)), F.lit(buckets)) + buckets).cast("int")))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, prior: float = 5_000.0, most_broadcast: int = 2_000_000) -> list[float]:
    """For each bucket the log of its trusted over its raw probability; the trusted counts are smoothed by `prior` raw n-grams."""
    trusted = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(1))
    dealt = docs.select("doc_id", "text").join(sent_whole(trusted, most_broadcast), "doc_id", "left")
    hashed = dealt.select(F.coalesce("good", F.lit(0)).alias("good"), F.transform(word_list(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    marked = hashed.select("good", F.explode(ngram_buckets(F.col("hashes"), buckets)).alias("bucket"))
    counts = marked.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect()  # at most 2 * buckets rows
    raw, good = [0.5] * 2 * buckets, [0] * 2 * buckets
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    out = []
    for part in (slice(0, buckets), slice(buckets, None)):  # a multinomial for each order
        n_raw, n_good = sum(raw[part]), sum(good[part])
        out += [math.log((g + prior * r / n_raw) / (n_good + prior) / (r / n_raw)) for g, r in zip(good[part], raw[part], strict=True)]
    return out


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, least: float = -0.11, **fit) -> DataFrame:
    """(doc_id, the base counts, base_failed, llr, kept), a row per row of docs."""
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in log_ratios(docs, labels, buckets, **fit))), ",").cast("array<float>")
    mean = lambda grams: F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(ratios, b)) / F.greatest(F.size(grams), F.lit(1))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = base_counts(docs).withColumn("base_failed", failed).withColumn("grams", ngram_buckets(F.col("hashes"), buckets))
    return found.withColumn("llr", mean(F.col("grams"))).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least)).drop("hashes", "grams")
