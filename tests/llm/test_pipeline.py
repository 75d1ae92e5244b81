"""The pipeline's stages against brute force, on a table with planted copies and junk."""

import random
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, rows = random.Random(4), []
    en, de = ("the of and to in is that it was for".split(), "der die und den von zu das mit sich des".split())
    for i in range(300):
        words = [rng.choice(en if i % 2 else de) + rng.choice(["", "er", "ing", "st"]) + rng.choice("abcdefgh") for _ in range(60)]
        text = " ".join(w + "###" for w in words) if i % 6 == 0 else " ".join(words) + "."
        rows.append([i, text, "en" if i % 2 else "de", "s", len(text)])
    for i, of in ((300, 1), (301, 1), (302, 3)):
        rows.append([i, rows[of][1] + " " * (i % 3), *rows[of][2:]])
    words = rows[5][1].split()
    words[30] = "changed"
    rows.append([303, " ".join(words), *rows[5][2:]])
    rows += [[304, None, "en", "s", 0], [305, "12 34", "en", "s", 5], [306, "", "en", "s", 0]]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{sf_dir}/stage{k}.parquet"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id for r in docs.collect()})
        if k < 4:
            assert docs.columns == columns
    clean = {i for i in range(300) if i % 6}
    assert clean <= seen[0] and not {i for i in range(300) if i % 6 == 0} & seen[0]
    assert clean <= seen[1] and not {304, 305, 306} & seen[1]
    assert 302 in seen[1] and not ({1, 300, 301} & seen[2]) - {1, 300, 301} and len({1, 300, 301} & seen[2]) == 1 and len({3, 302} & seen[2]) == 1
    assert {5, 303} <= seen[2] and 5 in seen[3] and 303 not in seen[3]
    assert seen[3] == seen[4]


def test_run(spark, sf_dir):
    got = pipeline.run(spark, sf_dir)
    assert got.count() and pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    """The table with null ids, repeated rows, very long texts, and columns of names that stages use themselves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = " ".join(r.text for r in docs.filter("doc_id in (1, 3, 7, 9, 11)").collect())
    extra = [(None, long + " without an id", "en", "s", 1), (None, None, None, None, None), (400, (long + " ") * 200, "en", "s", 1), (401, "x" * 300_000, "en", "s", 1), (402, "\u00a0\u3000", None, "s", 2)]
    odd = docs.unionByName(docs.filter("doc_id in (1, 2, 7)")).unionByName(spark.createDataFrame(extra, docs.schema))
    odd = odd.selectExpr("*", "1 as whole", "2 as id", "3 as __text", "map('k', doc_id) as m", "4 as `a.b`", "'g' as gone", "0.5 as score")
    d = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


def test_odd_rows_and_columns(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = Counter(r.doc_id for r in docs.select("doc_id").collect())
        out = stage(spark, docs, odd_dir)
        out.write.parquet(f"{odd_dir}/stage{k}.parquet")
        docs = spark.read.parquet(f"{odd_dir}/stage{k}.parquet")
        after = Counter(r.doc_id for r in docs.select("doc_id").collect())
        if k < 4:
            assert docs.columns == columns and after <= before, name  # rows go, none come or change
            assert docs.filter("whole = 1 and id = 2 and __text = 3 and `a.b` = 4 and gone = 'g' and score = 0.5 and m['k'] <=> doc_id").count() == docs.count(), name
        else:
            assert set(after) == set(before)
        if k == 1:
            assert 400 in after and 402 not in after
        if k >= 2 and k < 4:
            assert after[1] <= 1 and after[2] == after[7] == 1
    pieces = docs.filter("doc_id = 400").agg({"length": "sum"}).first()[0]
    assert pieces == docs.filter("doc_id = 400").first().doc_tokens > 100_000


def test_empty_table(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").filter("false")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, odd_dir)
        assert out.count() == 0, name
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_run_is_its_stages(spark, sf_dir):
    """run() gives every document that the stages keep, whole."""
    got = pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}
    short = got.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).filter("`sum(length)` <> `max(doc_tokens)`")
    assert short.count() == 0
