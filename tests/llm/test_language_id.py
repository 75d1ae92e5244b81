import itertools
import math
import zlib

import numpy as np
import public_tokenizers as files
from pyspark.sql import functions as F

from docspark.llm import language_id, queries

RANKS = files.path("byte_bpe_multi_50k.tiktoken")


def model(langs=("de", "en")):
    size = len(language_id.vocabulary(RANKS))
    p = np.random.default_rng(0).dirichlet(np.full(size, 0.5), len(langs))
    return language_id.Model(list(langs), np.log(np.maximum(p, 1e-30)), RANKS)


def brute(word, logp):
    vocabulary, total = language_id.vocabulary(RANKS), 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        prob = 1.0
        for a, b in itertools.pairwise(at):
            k = vocabulary.get(word[a:b])
            prob *= math.exp(logp[k]) if k is not None else math.exp(language_id.UNKNOWN) if b - a == 1 else 0
        total += prob
    return math.log(total)


def test_forward_sums_all_segmentations():
    m = model()
    for word in (" the", " ersteain", "a", " für", " xß日q"):
        got = m.word_scores([word, " other", " longerwordhere"])[0]
        assert np.allclose(got, [brute(word, m.logp[k]) for k in range(2)], rtol=1e-4)


def test_long_words_use_the_scaled_pass():
    m = model()
    word = " " + "erstein" * 10
    half = m.word_scores([word[: language_id.SHORT]])[0]
    assert np.isfinite(m.word_scores([word])[0]).all() and (m.word_scores([word])[0] < half).all()


def plain_sum(word, logp):
    """log of the sum over all segmentations, place by place."""
    vocabulary, sums = language_id.vocabulary(RANKS), [0.0]
    for e in range(1, len(word) + 1):
        terms = [sums[e - j] + logp[vocabulary[word[e - j : e]]] for j in range(1, min(e, language_id.LONGEST) + 1) if word[e - j : e] in vocabulary]
        if word[e - 1] not in vocabulary:
            terms.append(sums[e - 1] + language_id.UNKNOWN)
        sums.append(np.logaddexp.reduce(terms))
    return sums[-1]


def test_very_long_runs_are_not_cut():
    m, rng = model(), np.random.default_rng(2)
    for n in (language_id.RUN - 1, language_id.RUN, language_id.RUN + 1, 10_000, 3 * language_id.RUN):
        word = " " + "".join(rng.choice(list("erstnaidß日q"), n - 1))
        assert np.allclose(m.word_scores(["one", word])[1], [plain_sum(word, m.logp[k]) for k in range(2)], rtol=1e-9)
    assert language_id.words_of("1 " + "Ab" * 5000 + " c") == [" " + "ab" * 5000, " c"]


def brute_counts(word, logp):
    """Expected piece counts over all segmentations."""
    vocabulary, found, total = language_id.vocabulary(RANKS), {}, 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(at)]
        if all(x in vocabulary or len(x) == 1 for x in parts):
            prob = math.exp(sum(logp[vocabulary[x]] if x in vocabulary else language_id.UNKNOWN for x in parts))
            total += prob
            for x in parts:
                if x in vocabulary:
                    found[vocabulary[x]] = found.get(vocabulary[x], 0) + prob
    return {k: v / total for k, v in found.items()}


def test_expected_counts_match_brute_force():
    m = model()
    words, weights = [" the", " ersteain", "a", " xß日q", " für"], np.array([[2.0, 0], [1, 3], [0, 1], [1, 1], [5, 0.5]])
    got = m.expected(words, weights)
    for k in range(2):
        want = np.zeros(got.shape[1])
        for word, w in zip(words, weights[:, k], strict=True):
            for piece, n in brute_counts(word, m.logp[k]).items():
                want[piece] += w * n
        assert np.allclose(got[k], want, rtol=1e-6, atol=1e-12)
    long = " " + "erstaun" * 8  # the scaled pass against the sum over short words' counts
    assert np.isclose((m.expected([long], np.ones((1, 2))) * np.array([len(p) for p in language_id.vocabulary(RANKS)])).sum(1), len(long)).all()


def test_learning_matches_plain_rounds():
    texts, langs = ["the rest is", "der rest ist", "das erste", "the first"], ["en", "de", "de", "en"]
    got, names = language_id.train(texts, langs, RANKS, rounds=2, prior=0.05), ["de", "en"]
    logp = np.full((2, len(language_id.vocabulary(RANKS))), -np.log(len(language_id.vocabulary(RANKS))))
    for _ in range(2):
        counts = np.full(logp.shape, 0.05)
        for text, lang in zip(texts, langs, strict=True):
            for word in text.split():
                for piece, n in brute_counts(" " + word, logp[names.index(lang)]).items():
                    counts[names.index(lang), piece] += n
        logp = np.log(counts / counts.sum(1, keepdims=True))
    assert got.langs == names and np.allclose(got.logp, logp, rtol=1e-6)
    total = [sum(plain_sum(" " + w, logp[k]) for w in ("der", "rest")) for k in range(2)]
    (lang, score), = language_id.Scorer(got)(["Der, REST!"])
    assert lang == names[int(np.argmax(total))] and math.isclose(score, 1 / (1 + math.exp(min(total) - max(total))), rel_tol=1e-6)


def test_expected_counts_add_up_to_characters():
    m = model()
    words = [" the", " and", " erste"]
    counts = m.expected(words, np.ones((3, 2)))
    lengths = np.array([len(p) for p in language_id.vocabulary(RANKS)])
    assert np.allclose((counts * lengths).sum(1), sum(map(len, words)))


def test_learns_languages(docs, rows):
    texts, langs = language_id.sample(docs.filter("doc_id < 40"), 1000)
    m = language_id.train(texts, langs, RANKS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs.select("doc_id", "text"), m).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(40, 60))
    assert all(got[i] == ("und", 0.0) for i in (80, 81, 82, 83, 86))
    assert all(0 <= s <= 1 for _, s in got.values())


def test_sample_has_every_language(spark):
    common = spark.range(3000).selectExpr("id as doc_id", "concat('the common text ', id) as text", "'en' as lang")
    rare = spark.range(3000, 3003).selectExpr("id as doc_id", "'ein seltener text' as text", "'de' as lang")
    odd = spark.createDataFrame([(1, "the common text 1", "en"), (None, "x", "fr"), (4000, None, "fr"), (4001, "y", None)], "doc_id bigint, text string, lang string")
    docs = common.unionByName(rare).unionByName(odd)
    texts, langs = language_id.sample(docs, 20, 2)
    assert langs.count("de") == 2 and 20 <= langs.count("en") + 2 <= 22 and set(langs) == {"de", "en"}
    assert language_id.sample(docs, 20, 2) == (texts, langs)
    assert language_id.sample(docs, 1, 5)[1].count("de") == 3
    assert language_id.train(texts, langs, RANKS).langs == ["de", "en"]


def test_sample_is_the_lowest_hashes(spark):
    """Of every lang, whatever its size, and where one id has most of its rows."""
    rows = spark.range(5000).selectExpr("id as doc_id", "concat('t', id) as text", "if(id % 50 = 0, 'de', 'en') as lang")
    hot = spark.range(3000).selectExpr("if(id < 2990, 7000, 8000 + id) as doc_id", "'t' as text", "'fr' as lang")
    docs = rows.unionByName(hot)
    order = {r.doc_id: (r.h, r.doc_id) for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect()}
    by_lang = {}
    for r in docs.select("doc_id", "lang").distinct().collect():
        by_lang.setdefault(r.lang, []).append(r.doc_id)
    want = {k: sorted(v, key=order.get)[:9] for k, v in by_lang.items()}
    texts, langs = language_id.sample(docs, 0, 9)
    assert {k: sorted(t for t, lang in zip(texts, langs, strict=True) if lang == k) for k in by_lang} == {k: sorted("t" if k == "fr" else f"t{i}" for i in v) for k, v in want.items()}


def test_numerals_are_no_letters():
    scorer = language_id.Scorer(model())
    assert scorer(["²½ Ⅷ", "12", None, "", "_", "² a"])[:5] == [("und", 0.0)] * 5
    assert scorer(["² a"])[0][0] in ("de", "en")


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_language_id(spark, str(tmp_path)).collect()
    rows = docs.collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r.doc_id) for r in rows)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)
    texts, langs = language_id.sample(docs.filter("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 3 <> 1"), 1500)
    score = language_id.Scorer(language_id.train(texts, langs, RANKS))
    want = sorted((repr(r.doc_id), *score([r.text])[0]) for r in rows)
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-9) for a, b in zip(sorted((repr(r.doc_id), r.lang_pred, r.score) for r in got), want, strict=True))


def test_columns_that_clash_stay(docs):
    m = language_id.train(*language_id.sample(docs, 1000), RANKS)
    own = docs.withColumn("__lang", F.lit("mine")).withColumn("found", F.lit(1)).withColumn("__text", F.lit(2)).withColumn("lang_pred", F.lit("old"))
    assert language_id.keep_known(own, m).columns == own.columns
    assert language_id.keep_known(own, m).filter("__lang = 'mine' and found = 1 and __text = 2").count() == language_id.keep_known(docs, m).count()
    got = language_id.identify(own.select("doc_id", "text", "__lang", "found", "lang_pred"), m)
    assert got.columns == ["doc_id", "__lang", "found", "lang_pred", "score"] and got.filter("lang_pred = 'old'").count() == 0


def test_stage_and_no_model(docs, empty):
    m = language_id.train(*language_id.sample(docs, 1000), RANKS)
    kept = language_id.keep_known(docs, m)
    assert kept.columns == docs.columns
    assert {80, 81, 82, 83, 86}.isdisjoint(r.doc_id for r in kept.collect())
    assert language_id.train([], [], RANKS) is None
    assert language_id.keep_known(docs, None).filter("doc_id in (80, 86)").count() == 0
    assert language_id.identify(docs.select("doc_id", "text"), None).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty.select("doc_id", "text"), m).count() == 0
