import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.functions import metrics
from docspark.operators import clustered, generation, index, retrieval

ROWS = "row_id bigint, vec array<double>, type string, page int, section string, text string"


@pytest.fixture(scope="module")
def held(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), "table" if i % 3 == 0 else "text", i % 4, "s" if i % 2 else "", f"t{i}") for i in range(40)]
    rows += [(40, rows[7][1], "text", 1, "s", "tie"), (41, [0.0] * 4, "text", 1, "s", "zero")]
    return index.normalised(spark.createDataFrame(rows, ROWS)).cache()


def brute(held, query, k):
    rows = [(r.row_id, float(np.dot(r.vec, query)) / (np.linalg.norm(query) or 1)) for r in held.collect()]
    return sorted(rows, key=lambda x: (-round(x[1], 12), x[0]))[:k]


def want_of(held):
    return held.filter("row_id = 7").first().vec


def test_top_k(held):
    q = held.filter("row_id = 7").first().vec
    for k in (1, 5, 100):
        assert [r.row_id for r in retrieval.top_k(held, q, k).collect()] == [i for i, _ in brute(held, q, k)]
    assert [r.row_id for r in retrieval.retrieve(held, q, 0).collect()] == [i for i, _ in brute(held, q, 5)]
    assert [r.row_id for r in retrieval.top_k(held, [0.0] * 4, 2).collect()] == [0, 1]


def test_filter_follows_the_search(held):
    q = held.filter("row_id = 7").first().vec
    got = [r.row_id for r in retrieval.retrieve(held, q, 3, "table").collect()]
    assert got == [i for i, _ in brute(held, q, 9) if i < 40 and i % 3 == 0][:3]


def test_batch(spark, held, monkeypatch):
    queries = held.filter("row_id % 9 = 0").select(F.col("row_id").alias("query_id"), "vec")
    want = sorted((q.query_id, n + 1, i) for q in queries.collect() for n, (i, _) in enumerate(brute(held, q.vec, 6)))
    assert sorted((r.query_id, r.rank, r.row_id) for r in retrieval.top_k_batch(held.repartition(5), queries, 6).collect()) == want
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)  # several blocks
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 3)
    assert sorted((r.query_id, r.rank, r.row_id) for r in retrieval.top_k_batch(held, queries, 6).collect()) == want
    nulls = spark.createDataFrame([(90, None, "text", 1, "s", "no vector")], ROWS)
    assert sorted((r.query_id, r.rank, r.row_id) for r in retrieval.top_k_batch(held.unionByName(nulls), queries.unionByName(nulls.select(F.col("row_id").alias("query_id"), "vec")), 6).collect()) == want
    assert retrieval.top_k(held.unionByName(nulls), want_of(held), 50).filter("row_id = 90").count() == 0
    assert retrieval.top_k_batch(held, queries.filter("false"), 6).count() == 0
    assert retrieval.top_k_batch(held.filter("false"), queries, 6).count() == 0


def test_single_and_batch_agree(spark):
    """Index vectors as they are, queries over their length; what has no score is left out of both."""
    rows = [(1, [10.0, 10.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]), (6, []), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [0.0, 0.0])]
    index_ = spark.createDataFrame(rows, "row_id bigint, vec array<double>")
    one = [(r.row_id, r.score) for r in retrieval.top_k(index_, [2.0, 0.0], 9).collect()]
    assert one == [(1, 10.0), (2, 1.0), (9, 0.0)]
    asked = spark.createDataFrame([(0, [2.0, 0.0]), (1, None), (2, [1.0, None]), (3, [0.0, 0.0, 1.0])], "query_id bigint, vec array<double>")
    got = sorted(map(tuple, retrieval.top_k_batch(index_, asked, 9).collect()))
    assert got == [(0, 1, 1, 10.0), (0, 2, 2, 1.0), (0, 3, 9, 0.0), (3, 1, 5, 3.0)]


def test_vectors_are_normalised_once(spark):
    """No filter asks for the normalised vector, which would be worked out for it once more."""
    raw = spark.createDataFrame([(1, [3.0, 4.0])], "row_id bigint, vec array<double>")
    for df in (retrieval.top_k(index.normalised(raw), [1.0, 0.0], 1), retrieval.top_k_batch(index.normalised(raw), raw.withColumnRenamed("row_id", "query_id"), 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("SQRT(") == 1 and not [x for x in plan.split("\n") if "Filter" in x and "transform" in x], plan


def clustered_rows(n, d, spread, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, d))
    x = centres[np.arange(n) % 20] + spread * rng.normal(size=(n, d))
    return [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize(("spread", "lists"), [(0.1, 32), (2.0, 8), (0.3, 1), (0.3, 500)])
def test_clustered_equals_batch(spark, spread, lists):
    rows = clustered_rows(3000, 12, spread)
    rows += [(5000, rows[4][1]), (5001, rows[4][1]), (5002, None), (5003, [1.0, None] * 6), (5004, [float("nan")] * 12), (5005, [1.0, 2.0])]  # ties, and what takes no part
    df = spark.createDataFrame(rows, "row_id bigint, vec array<double>").repartition(3)
    asked = df.filter("row_id % 25 = 0 or row_id in (4, 5001)").select(F.col("row_id").alias("query_id"), F.transform("vec", lambda x: x * 3).alias("vec"))
    best, work = clustered.top_k(clustered.build(df, lists=lists), asked, 7)
    want = retrieval.top_k_batch(df.filter("row_id <> 5005"), asked.filter("query_id <> 5005"), 7)
    near = lambda found: sorted((r.query_id, r["rank"], r.row_id, round(r.score, 9)) for r in found.collect())
    assert near(best) == near(want)
    assert work["finished"] <= work["met"] <= work["all"] == 3002 * asked.filter("vec is not null and query_id < 5002").count()
    if spread == 0.1:
        assert work["met"] < work["all"] / 3


def test_clustered_without_rows(spark):
    none = spark.createDataFrame([], "row_id bigint, vec array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "row_id bigint, vec array<double>")
    asked = some.withColumnRenamed("row_id", "query_id")
    assert clustered.top_k(clustered.build(none), asked, 3)[0].count() == 0
    assert clustered.top_k(clustered.build(some), asked.filter("false"), 3)[0].count() == 0
    assert [tuple(r) for r in clustered.top_k(clustered.build(some), asked, 3)[0].collect()] == [(1, 1, 1, 1.0)]


def test_normalised(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "i int, vec array<double>")
    assert [r.vec for r in index.normalised(df).orderBy("i").collect()] == [[0.6, 0.8], [0.0, 0.0]]
    with pytest.raises(Exception, match="vectors have 3 dimensions, not 2"):
        index.normalised(df, dim=3).collect()


def test_index_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        index.load(spark, path)
    chunks = spark.createDataFrame([("a", "c1", "t", "text", 1, "s", [3.0, 4.0])], "source string, chunk_id string, text string, type string, page int, section string, vec array<double>")
    index.write(chunks, path)
    index.append(chunks.withColumn("source", F.lit("b")), path, 2)
    assert tuple(index.size(index.load(spark, path)).first()) == (2, 2)
    index.write(chunks, path)
    assert index.load(spark, path).count() == 1
    index.clear(spark, path)
    assert index.size(index.load(spark, path)).first().index_size == 0
    index.append(chunks, path)
    for _ in range(2):  # a write with a name replaces itself, and nothing else
        index.write(chunks.withColumn("source", F.lit("c")), path, part="one")
    assert index.load(spark, path).count() == 2 and index.load(spark, path).filter("source = 'c'").count() == 1 and "part" not in index.load(spark, path).columns


def test_contexts_and_sources(spark):
    hits = spark.createDataFrame([(1, 2, "image_caption", 0, "x", "B", "c2", 0.123456), (1, 1, "text", 3, "sec", "A", "c1", 0.5), (1, 3, None, 2, "", "C" * 120, "c3", 0.1)], "query_id bigint, rank int, type string, page int, section string, text string, chunk_id string, score double")
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    args = [F.col(c) for c in ("rank", "text", "page", "section")]
    got = {r.query_id: r.context for r in retrieval.contexts(hits, queries, retrieval.fragment(*args, F.col("type"))).collect()}
    assert got[1] == "[Фрагмент 1] (текст, стр. 3, раздел: sec):\nA\n\n---\n\n[Фрагмент 2] (описание графика/изображения):\nB\n\n---\n\n[Фрагмент 3] (текст, стр. 2):\n" + "C" * 120
    assert got[2] == "Контекст не найден."
    plain = retrieval.contexts(hits, queries, retrieval.fragment(*args)).filter("query_id = 1").first().context
    assert plain.startswith("[Фрагмент 1] (стр. 3, раздел: sec):\nA\n\n---\n\n[Фрагмент 2]:\nB")
    assert retrieval.contexts(hits, queries, retrieval.plain_fragment(F.col("rank"), F.col("text"), F.lit("x"))).filter("query_id = 1").first().context.startswith("[Фрагмент 1, x]:\nA")
    assert [(r.score, r.chunk_type, len(r.text_preview)) for r in retrieval.sources(hits).orderBy("rank").collect()] == [(0.5, "text", 1), (0.1235, "image_caption", 1), (0.1, "text", 100)]


def test_answers(spark):
    asked = spark.createDataFrame([(1, "Q?", "c" * 300)], "query_id bigint, question string, context string")
    row = generation.answers(asked).first()
    assert row.model == "stub" and row.context_used == "c" * 200 + "..." and row.usage.total_tokens == 0
    assert row.answer == "[LLM API недоступен — показываю найденный контекст]\n\nВопрос: Q?\n\nНайденные фрагменты:\n" + "c" * 300
    down = generation.Endpoint(url="http://127.0.0.1:9/none", key="test", timeout=0.2)
    assert generation.answers(asked, down).first().model == "stub" and not down.available(0.2)
    assert not generation.Endpoint().usable
    prompt = asked.select(generation.user_prompt(F.col("context"), F.col("question")).alias("a"), generation.chart_prompt(F.lit("k"), F.lit(""), F.lit("o" * 600)).alias("b")).first()
    assert prompt.a.startswith("Контекст из документа:\nccc") and prompt.a.endswith("---\n\nВопрос: Q?\n\nОтвет:")
    assert "(описание недоступно)" in prompt.b and "o" * 500 in prompt.b and "o" * 501 not in prompt.b
    assert generation.no_index(asked).first().model == "none"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_metrics(spark):
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = (["x%d" % v for v in rng.integers(0, 6, rng.integers(0, 30))] for _ in range(2))
        assert metrics.lcs_length(a, b) == lcs(a, b)
    assert metrics.rouge_score("a b c d", "a c d e") == 0.75 and metrics.rouge_score("", "a") == 0 and metrics.rouge_score("привет мир", "привет") == 0.6667 and metrics.rouge_score("привет", "привет", "ascii") == 0
    assert metrics.bleu_score("the cat sat", "the cat sat") == 1.0 and metrics.bleu_score("a", "b") == 0 and metrics.bleu_score(None, "b") == 0
    assert metrics.bleu_score("a b c d", "a c") == round(np.exp(1 - 2) * np.exp(0.5 * np.log(1.0) + 0.5 * np.log(0.1)), 4)
    df = spark.createDataFrame([("The cat!", "a cat"), ("the a", "x"), ("", "x"), ("dog cat", "DOG"), (None, None)], "a string, c string")
    assert [r.x for r in df.select(metrics.faithfulness(F.col("a"), F.col("c")).alias("x")).collect()] == [1.0, 1.0, 0.0, 0.5, 0.0]


def test_first_visual(spark):
    df = spark.createDataFrame([(2, "ДИАГРАММА b"), (1, "see График a"), (0, "none")], "page int, text string")
    assert retrieval.first_visual(df, ["график", "диаграмма"], "page").first().page == 1


def test_clustered_copies_no_query_for_each_list(spark):
    rows = [(i, [math.cos(i), math.sin(i), math.cos(3 * i)]) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<double>")
    index = clustered.build(df, lists=32)
    asked = clustered._asked(index, df, "row_id").withColumn("kth", F.lit(-1.0))  # needs every list
    assert clustered._visits(index, asked, 1, True).count() == clustered._visits(index, asked, 1, False).count() == 600


def test_clustered_sample_comes_from_one_task(spark, monkeypatch):
    """Rows that are collected in an order with a limit come from each task, as many from each."""
    from pyspark.sql.classic.dataframe import DataFrame

    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "row_id bigint, vec array<double>")
    monkeypatch.setattr(DataFrame, "toPandas", None)
    index = clustered.build(df.repartition(4))
    assert index.rows.sum() == 40


def test_clustered_long_lists_have_several_slices():
    rows = np.array([10, 0, clustered.SLICE, 3 * clustered.SLICE, 5])
    begin, number = clustered.Clustered(None, np.zeros((5, 2)), np.zeros(5), rows).slices()
    assert number.tolist() == [1, 1, 1, 3, 1] and begin.tolist() == [0, 0, 1, 2, 5]
