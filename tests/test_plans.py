import json
from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docspark.operators import layout
from docspark.plans import benchmark, oracles, pipeline, shared
from docspark.plans import queries as core
from docspark.plans.workers import with_workers
from docspark.sources import backends, sinks
from docspark.streaming import ingest
from docspark.streaming import queries as streams

SF = "/root/testdata/sf0.001"
TABLES = "documents pages conversations embeddings benchmark labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = (core.queries() | streams.queries())[name](with_workers(spark), SF)
    names = sorted(got.columns)
    sql = duck.execute(f"SELECT {', '.join(names)} FROM ({oracles.oracle_sql()[name]}) t").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, sql))


def test_names_and_entry(spark):
    found = __spark_entry__.queries()
    assert set(oracles.oracle_sql()) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() == 40


@pytest.mark.parametrize("name", ["rouge_l", "bench_summary"])
def test_metric_queries(spark, name):
    rows = core.queries()[name](with_workers(spark), SF).collect()
    assert rows and all(0 <= v <= 1 for r in rows for k, v in r.asDict().items() if k.startswith(("rouge", "avg")))


DOCS = [(1, "HEAD\n" + "cats like warm milk and soft beds in winter. " * 3), (2, "Title:\n" + "dogs run fast over green fields in summer days. " * 3)]


def test_ingest_and_query(spark, tmp_path):
    p = pipeline.Pipeline(with_workers(spark), f"file://{tmp_path}/index", dim=64)
    questions = spark.createDataFrame([(1, "what do cats like"), (2, "where do dogs run")], "query_id bigint, question string")
    answers, sources = p.query(questions)
    assert {r.model for r in answers.collect()} == {"none"} and sources.count() == 0 and p.get_stats().first().index_size == 0
    blocks = layout.line_blocks(spark.createDataFrame(DOCS, "doc_id bigint, text string"))
    assert p.ingest(blocks).first().index_size == 2
    answers, sources = p.query(questions, k=1)
    got = {r.query_id: r.answer for r in answers.collect()}
    assert "cats" in got[1] and "dogs" in got[2] and sources.count() == 2
    assert p.query(questions, source="2")[1].select("text_preview").distinct().count() == 1
    results = benchmark.run(questions.withColumn("reference", F.lit("cats like milk")).withColumn("category", F.lit(None).cast("string")), answers)
    assert {r.category for r in results.collect()} == {"unknown"} and benchmark.summary(results).first().questions == 2
    said = json.loads(sinks.report_json(results).first().value)
    assert said["num_questions"] == 2 and len(said["results"]) == 2
    sinks.write_results(results, f"file://{tmp_path}/results")
    assert spark.read.json(f"file://{tmp_path}/results/results").count() == 2 and spark.read.json(f"file://{tmp_path}/results/report").first().num_questions == 2
    sinks.write_markdown(spark.createDataFrame([("d", "# x\n\ny")], "doc_id string, markdown string"), f"file://{tmp_path}/md")
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/md").collect()] == [("d", "# x\n\ny")]
    assert benchmark.sample_pairs(spark).count() == 3 and benchmark.summary(results.filter("false")).first().questions == 0


def test_stream_into_index(spark, tmp_path):
    p = pipeline.Pipeline(with_workers(spark), f"file://{tmp_path}/index", dim=64)
    spark.createDataFrame(DOCS, "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    for _ in range(2):  # the second run finds nothing new
        docs = spark.readStream.schema("doc_id bigint, text string").parquet(f"{tmp_path}/docs")
        ingest.stream_into_index(docs, p, f"file://{tmp_path}/check").awaitTermination()
        assert p.get_stats().first().index_size == 2


def test_back_ends_are_optional(spark):
    df = with_workers(spark).createDataFrame([(1, bytearray(b"no image"), "a b"), (2, None, None)], "i int, png binary, t string")
    row = df.select(backends.ocr_text(F.col("png")).alias("a"), backends.caption(F.col("png")).alias("b"), backends.line_count(F.col("png")).alias("c"), backends.image_logits(F.col("png"), ["x"]).alias("d"), backends.pixel_clusters(F.col("png")).alias("e"), backends.embed_images(F.col("png")).alias("f")).first()
    assert row.a == "" and row.b == "" and row.c == 0 and row.d is None and row.e == [] and row.f is None
    vecs = [r.v for r in df.select(backends.embed_text(F.col("t"), dim=8).alias("v")).collect()]
    assert abs(sum(x * x for x in vecs[0]) - 1) < 1e-9 and vecs[1] == [0.0] * 8


def test_image_blocks_and_order(spark):
    found = with_workers(spark).createDataFrame([("d", 2, 0, bytearray(b"x"), "p.png")], "doc_id string, page_num int, idx int, png binary, image_path string")
    text = spark.createDataFrame([("d", 0, 1, "text", "one"), ("d", 1, 3, "text", "two")], "doc_id string, block_no int, page_num int, block_type string, text string")
    every = pipeline.ordered_union(text, pipeline.image_blocks(found))
    assert [r.block_type for r in every.orderBy("block_no").collect()] == ["text", "text", "image"]
    paged = pipeline.ordered_union(text, pipeline.image_blocks(found), by_page=True)
    assert [r.page_num for r in paged.orderBy("block_no").collect()] == [1, 2, 3]


def test_k_means():
    import numpy as np

    points = np.repeat(np.array([[0.0, 0, 0], [200, 0, 0]]), [30, 10], axis=0)
    assert sorted(n for _, n in backends.k_means(points, 5)) == [10, 30]


def test_plans_push_down(spark):
    plan = core.queries()["block_type_counts"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<text:string>" in plan
    top = core.queries()["topk_single"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in top and "Exchange" not in top


def test_scratch_tables_go(spark):
    root = Path(shared.shared_dir(spark).removeprefix("file://")) / "docspark"
    kept = shared.stash(spark.range(3), "kept")
    with shared.scratch(spark):
        gone = shared.stash(spark.range(4), "gone")
        assert gone.count() == 4 and len(list(root.glob("gone-*"))) == 1
        with pytest.raises(ZeroDivisionError), shared.scratch(spark):
            shared.stash(spark.range(5), "inner")
            1 / 0  # noqa: B018
        assert not list(root.glob("inner-*")) and gone.count() == 4
    assert not list(root.glob("gone-*")) and kept.count() == 3
    shared.drop_stash(kept)
    assert not list(root.glob("kept-*"))


def test_shared_folder_has_to_be_named_on_a_cluster():
    class Session:
        conf, sparkContext = {}, SimpleNamespace(master="spark://host:7077")  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
