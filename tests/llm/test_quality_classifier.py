import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import quality_classifier as qc
from docspark.llm import queries
from docspark.llm.common import BASE, LONG_SPAN


@pytest.fixture(scope="module")
def junk(spark):
    rows = []
    for i in range(120):
        words = [f"w{(i * j) % 97}" for j in range(1, 60)]
        rows.append((i, " ".join(w + "###" for w in words) if i % 5 == 0 else " ".join(words) + "."))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(80)], "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(junk):
    docs, labels = junk
    ranker = qc.fit(docs, labels)
    got = {r.doc_id: r.score for r in qc.score(docs, ranker).collect()}
    assert all((got[i] >= qc.AT) == (i % 5 > 0) for i in range(80, 120))
    assert all(0 <= s <= 1 for s in got.values())


def test_scores_keep_the_order_of_the_ranking():
    x = np.random.default_rng(0).normal(size=(500, 3))
    good = (x[:, 0] > -1).astype(int)
    ranker = qc.train(x, good)
    s = ranker(x)
    assert (s >= qc.AT).mean() == pytest.approx(good.mean(), abs=0.01)
    assert np.corrcoef(s, x[:, 0])[0, 1] > 0.7


def test_features_of_odd_texts():
    texts = ["", " ", "a", "a a\na a\n\nb", "\n\n"]
    raw = [t.encode() for t in texts]
    x = qc.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.isfinite(x).all() and len(x) == 5
    assert qc.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[3, -1] == pytest.approx(1 / 3)


CLASSES = ["#*$%&|<>@^~=+_{}[]\\/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?", "0123456789", ".,;:"]


def plain_features(text):
    """The same numbers, one text at a time."""
    raw = text.encode()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x.strip(" \t\n\x0b\x0c\r") for x in text.split("\n")]
    lines = [x for x in lines if x]
    n, size = max(1, len(words)), max(1, len(raw))
    out = [math.log1p(len(words))]
    for share in [*(sum(text.count(c) for c in chars) / size for chars in CLASSES), sum(b > 127 for b in raw) / size]:
        out += [share, math.sqrt(share)]
    out.append(math.log1p(sum(len(w.encode()) for w in words) / n))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    return [*out, again, math.sqrt(again), len(set(words)) / n, (len(lines) - len(set(lines))) / max(1, len(lines))]


def plain_hash(word):
    """The 64-bit hash of a word, in whole numbers."""
    if len(word) > LONG_SPAN:
        return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    m = (1 << 64) - 1

    def mixed(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & m
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & m
        return h ^ (h >> 31)

    h = mixed((len(word) + int(BASE)) & m)
    for i in range(0, len(word), 8):
        h = (mixed(h ^ int.from_bytes(word[i : i + 8], "little")) + int(BASE)) & m
    return h


def plain_ngrams(raw):
    low, out = bytes(b + 32 if 65 <= b <= 90 else b for b in raw), []
    three = [(low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * 2654435761 % (1 << 32) >> 16 for i in range(len(low) - 2)]
    for found in ([plain_hash(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", low)], three):
        share = np.bincount([x % 256 for x in found], minlength=256) / max(1, len(found))
        out += np.sqrt(share).tolist()
    return out


def test_features_match_plain_ones(rows):
    texts = [r[1] or "" for r in rows] + ["a\n a \nb b b\n\n", "é ü é\n!?", "\x0b", "x" * 3000]
    raw = [t.encode() for t in texts]
    got = qc.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose(got, [plain_features(t) + plain_ngrams(t.encode()) for t in texts])


def test_fit_is_the_least_loss_and_the_threshold_its_quantile():
    rng = np.random.default_rng(3)
    x, good = rng.normal(size=(400, 4)), (rng.random(400) < 0.7).astype(int)
    ranker = qc.train(x, good, pairs=5000, ridge=1e-2, seed=9)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    own = np.random.default_rng(9)
    ones, zeros = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    d = z[own.choice(ones, 5000)] - z[own.choice(zeros, 5000)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + 1e-2 / 2 * (w @ w)
    least = loss(ranker.weights)
    assert all(loss(ranker.weights + step) > least for step in np.vstack([np.eye(4), -np.eye(4)]) * 1e-3)
    scores = sorted(((x - x.mean(0)) / x.std(0)) @ ranker.weights)
    assert scores[len(zeros) - 2] <= ranker.threshold <= scores[len(zeros) + 1]


def test_query(spark, junk, tmp_path):
    docs, labels = junk
    docs.unionByName(spark.createDataFrame([(500, None), (None, ""), (7, "again " * 30)], "doc_id bigint, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op8_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == 123 and all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id != 7 and (r.held_out or r.doc_id >= 80)]
    assert held and all(r.predicted == int(r.doc_id % 5 > 0) for r in held)


def test_columns_that_clash_stay(junk):
    docs, labels = junk
    ranker, own = qc.fit(docs, labels), docs.selectExpr("*", "1 as __score", "2 as __text", "3 as `a.b`", "map('k', 1) as m")
    assert qc.keep_good(own, ranker).columns == own.columns and qc.keep_good(own, ranker).filter("__score = 1 and __text = 2").count() == qc.keep_good(docs, ranker).count()
    assert qc.score(own, ranker).columns == ["doc_id", "__score", "__text", "a.b", "m", "score"]


def test_defined_cases(docs, labels, empty, junk):
    ranker = qc.fit(*junk)
    out = qc.keep_good(docs, ranker)
    assert out.columns == docs.columns
    assert qc.score(docs, ranker).filter("score is null").count() == 0
    flat = qc.fit(docs, labels.filter("quality = 1"))
    assert qc.keep_good(docs, flat).count() == docs.count()
    assert qc.score(empty, ranker).count() == 0
    assert qc.keep_good(docs, qc.fit(empty, labels)).count() == docs.count()


def test_all_labelled_rows_are_learned_from(spark, junk):
    """As many as were once a sample, and some more."""
    n = 20_500
    text = F.concat_ws(" ", F.lit("word"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, "### ###").otherwise("fine."))
    docs = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", text)
    ranker = qc.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 7 > 0) as quality"))
    raw = [r.text.encode() for r in docs.collect()]
    x = qc.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])).astype(np.float32)
    assert np.allclose(ranker.mean, x.mean(0, dtype=np.float64), rtol=1e-9) and np.allclose(ranker.spread[:18], np.maximum(x.std(0, dtype=np.float64), 1e-6)[:18], rtol=1e-6)
    raw_scores = np.sort(qc.standard(x, ranker.mean, ranker.spread) @ ranker.weights)
    bad = len(range(0, n, 7))
    assert ranker.threshold == pytest.approx(np.quantile(raw_scores, bad / n, method="midpoint"))


def test_few_bad_rows_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(qc, "ROWS", 16)
    docs = spark.createDataFrame([(i, ("bad### " if i in (7, 50) else "good ") * (20 + i % 5)) for i in range(300)], "doc_id bigint, text string")
    sizes = {0: 2, 1: 298}
    blocks = qc._dealt(docs.selectExpr("doc_id", "int(doc_id not in (7, 50)) as q", "text"), sizes).collect()
    labels = [np.frombuffer(b.good, np.int8) for b in blocks]
    assert len(blocks) == 19 and all((x == 0).sum() == 2 for x in labels) and sum(np.frombuffer(b.own, bool).sum() for b in blocks) == 300
    ranker = qc.fit(docs, docs.selectExpr("doc_id", "int(doc_id not in (7, 50)) as quality"))
    assert {r.doc_id for r in qc.score(docs, ranker).collect() if r.score < qc.AT} == {7, 50}


def test_every_row_of_a_block_is_in_pairs():
    good = np.array([1] * 50 + [0] * 7)
    better, worse = qc.pairs_of(3, good, 5)
    seen = np.bincount(np.r_[better, worse], minlength=57)
    assert (good[better] == 1).all() and (good[worse] == 0).all() and seen.min() == qc.PARTNERS and np.ptp(seen[50:]) <= 1


def test_ranked(spark):
    values = np.r_[np.random.default_rng(1).normal(size=500), [2.0] * 40, 1e9, -1e-300]
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    assert all(qc.ranked(df, k, 8) == np.sort(values)[k] for k in (0, 17, 250, 505, 541))


def test_blocks_lie_in_small_rows_a_file_each(spark, monkeypatch):
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('word ', id, if(id % 7 = 0, ' ### ###', ' fine.')) as text")
    kept, real = [], qc.stash

    def seen(df, name, *rest):
        out = real(df, name, *rest)
        if name == "labelled":
            kept.append(out.select("block", F.input_file_name().alias("file"), F.length("x").alias("size"), F.length("good").alias("n")).collect())
        return out

    monkeypatch.setattr(qc, "stash", seen)
    qc.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 7 > 0) as quality"))
    assert sum(r.n for r in kept[0]) == 9000 and max(r.size for r in kept[0]) <= 1 << 19
    assert len({r.block for r in kept[0]}) == len({r.file for r in kept[0]}) == len({(r.block, r.file) for r in kept[0]}) == 3
