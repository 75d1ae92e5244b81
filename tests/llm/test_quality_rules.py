import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from docspark.llm import queries, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORDS.findall(text or "")
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(wins)
    cover = {i + j for i, w in enumerate(wins) if often[w] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


@pytest.fixture(scope="module")
def judged(docs, labels):
    return quality_rules.judge(docs, labels).collect()


def test_base_counts_match_brute_force(judged, rows):
    want = sorted([(r[0], *base(r[1])) for r in rows], key=repr)
    assert sorted([tuple(r[:6]) for r in judged], key=repr) == want


def test_verdicts(judged):
    for r in judged:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert r.kept == (not r.base_failed and r.llr >= -0.11)


def test_ratio_matches_brute_force(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    ratios = quality_rules.log_ratios(docs, labels, buckets=64, prior=1.0)
    assert len(ratios) == 128
    got = {r.doc_id: r.llr for r in quality_rules.judge(docs, labels, buckets=64, prior=1.0).collect()}
    assert got[1] > 0 > got[2] and got[3] == 0


def plain_llr(texts, trusted, buckets, prior):
    """The mean log ratio of each text, worked out with another library's hashes."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), seed=42))
    pair = lambda a, b: signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), seed=42)))
    grams = []
    for t in texts:
        h = [word(w) for w in WORDS.findall(t or "")]
        grams.append([(1, x % buckets) for x in h] + [(2, pair(b, a) % buckets) for a, b in zip(h, h[1:], strict=False)])
    raw, good = Counter(g for x in grams for g in x), Counter(g for x, ok in zip(grams, trusted, strict=True) if ok for g in x)
    total = {n: (sum(raw[n, b] + 0.5 for b in range(buckets)), sum(good[n, b] for b in range(buckets))) for n in (1, 2)}

    def ratio(g):
        n_raw, n_good = total[g[0]]
        p = (raw[g] + 0.5) / n_raw
        return math.log((good[g] + prior * p) / (n_good + prior) / p)

    return [sum(map(ratio, x)) / max(1, len(x)) for x in grams]


def test_query_matches_brute_force(spark, docs, labels, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    trusted = {r.doc_id for r in labels.collect() if r.doc_id is not None and r.quality == 1}
    want = []
    for r, llr in zip(rows, plain_llr([r[1] for r in rows], [r[0] in trusted for r in rows], 1 << 14, 5000.0), strict=True):
        n, *_, again = base(r[1])
        failed = n < 20 or 100 * again > 30 * n
        want.append((repr(r[0]), failed, not failed and llr >= -0.11, llr))
    got = sorted(((repr(r.doc_id), r.base_failed, r.kept, r.llr) for r in queries.op6_quality_rules(spark, str(tmp_path)).collect()))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], abs_tol=1e-5)


def test_every_trusted_row_counts(spark):
    n = 20_500
    docs = spark.range(n).selectExpr("id as doc_id", "concat('w', id % 7, ' good') as text").unionByName(spark.createDataFrame([(n, "bad bad"), (None, "bad w1")], "doc_id bigint, text string"))
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    want, raw = Counter(), Counter()
    for r in docs.select("doc_id", quality_rules.ngram_buckets(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)), 64).alias("b")).collect():
        raw.update(r.b)
        want.update(r.b if r.doc_id is not None and r.doc_id < n else [])
    got = quality_rules.log_ratios(docs, labels, buckets=64, prior=1.0)
    for part in (range(64), range(64, 128)):
        n_raw, n_good = sum(raw[b] + 0.5 for b in part), sum(want[b] for b in part)
        for b in part:
            p = (raw[b] + 0.5) / n_raw
            assert math.isclose(got[b], math.log((want[b] + p) / (n_good + 1) / p), rel_tol=1e-9, abs_tol=1e-9)


def test_overlapping_repeats(spark):
    texts = ["w " * 9, " ".join("abcdefgh") * 2, " ".join("abcdefgh") + " x " + " ".join("abcdefgh"), " ".join("abcdefghi") + " " + " ".join("abcdefghi")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.base_counts(df).collect()} == {i: base(t)[4] for i, t in enumerate(texts)}


def test_no_labels_and_empty(docs, labels, empty):
    none = labels.filter("false")
    assert all(r.llr == 0 for r in quality_rules.judge(docs, none).collect())
    assert quality_rules.judge(empty, labels).count() == 0
