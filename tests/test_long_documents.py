import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import chunking, long_documents, markdown

SCHEMA = "doc_id bigint, block_no bigint, page_num int, block_type string, text string"
ORDER = ["doc_id", "section_no", "chunk_no"]


def made(seed, docs, most):
    rng, rows = random.Random(seed), []
    for doc in docs:
        page = 1
        for n in range(rng.randint(0, most)):
            page += rng.random() < 0.1
            kind = rng.choice(["text"] * 6 + ["header", "list", "table", "no_text"])
            words = " ".join(rng.choice(["word", "longer", "to", "end.", "stop!", "ok?"]) for _ in range(rng.choice([1, 5, 20, 80])))
            text = {"header": f"Head {n}", "table": "a  1\nb  2", "no_text": None}.get(kind, words)
            rows.append((doc, n * rng.choice([1, 1, 1]), page if rng.random() < 0.97 else None, kind, text))
    return rows


@pytest.fixture(scope="module")
def blocks(spark):
    rows = made(1, [1, 2, 3, None], 150) + [(9, n, 1, "text", "no heading here. " * (n % 9)) for n in range(120)] + [(10, 0, None, "header", "ONLY A HEADING"), (11, 3, 2, "no_text", None)]
    rows += [(12, n, 1, "header" if n < 5 else "text", f"h{n}") for n in range(9)] + [(13, n, 1, "list", f"• item {n}") for n in range(300)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(params=[3, 4096])
def bucket(request, monkeypatch):
    monkeypatch.setattr(long_documents, "BUCKET", request.param)
    monkeypatch.setattr(long_documents, "PARAGRAPHS", max(1, request.param // 2))


def test_lines_are_the_markdown(blocks, bucket):
    got = long_documents.lines(blocks).groupBy("doc_id").agg(long_documents._joined("line", "block_no", "k", gap="\n").alias("markdown"))
    assert table(got) == table(markdown.build(blocks))


def test_sections(blocks, bucket):
    want = chunking.sections(markdown.build(blocks)).select("doc_id", "section_no", "title", "page", "type", F.length("body").cast("bigint").alias("length"))
    assert table(long_documents.sections(blocks)) == table(want.select("doc_id", "section_no", "title", "length", "page", "type"))


@pytest.mark.parametrize("sizes", [(1000, 100, 50), (120, 30, 10)])
def test_chunks_in_rows_and_over_buckets(blocks, bucket, sizes):
    want = table(chunking.chunk_markdown(markdown.build(blocks), *sizes))
    for whole in (0, 1 << 20):
        got = long_documents.chunk_blocks(blocks, *sizes, whole=whole)
        assert table(got.select("chunk_id", *ORDER, "text", "type", "page", "section")) == want


def test_one_long_document_fills_all_tasks(spark):
    n = 200_000
    text = F.concat(F.lit("block "), F.col("id").cast("string"), F.lit(" says. "), F.repeat(F.lit("more words here "), (F.col("id") * 7 % 23).cast("int")))
    blocks = spark.range(n).select(F.lit(5).cast("bigint").alias("doc_id"), F.col("id").alias("block_no"), (F.col("id") / 20).cast("int").alias("page_num"), F.when(F.col("id") == 10, "header").otherwise("text").alias("block_type"), text.alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = [r["count"] for r in long_documents.section_lines(blocks).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) == 4 and max(shares) < 0.5 * sum(shares)
    got = long_documents.chunk_blocks(blocks, whole=10_000).filter("section_no = 1")
    row = got.agg(F.count("*").alias("n"), F.max("chunk_no").alias("last"), F.max(F.length("text")).alias("longest"), F.count_distinct("chunk_no").alias("own")).first()
    assert row.n == row.own == row.last + 1 and row.longest <= 1000
    # Every block is in a chunk whole, and each chunk but the first begins with the end of the one before.
    named = got.select("chunk_no", F.explode(F.regexp_extract_all("text", F.lit(r"block (\d+) says"), F.lit(1))).alias("b")).agg(F.count_distinct("b")).first()[0]
    assert named == n - 11
    joined = got.alias("a").join(got.alias("b"), F.expr("b.chunk_no = a.chunk_no + 1")).select(F.expr("startswith(b.text, right(rtrim(a.text), 40))").alias("ok"), F.expr("contains(left(b.text, 110), right(rtrim(a.text), 40))").alias("has"))
    assert joined.filter("not has").count() == 0


def test_without_blocks_and_bad_sizes(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert long_documents.chunk_blocks(none).count() == 0 and long_documents.sections(none).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        long_documents.chunk_blocks(none, 100, 50)


def test_lines_of_one_bucket_are_dealt_once(blocks):
    for made in (long_documents.sections(blocks), long_documents.chunk_blocks(blocks)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_joins_of_longer_documents_deal_no_line_anew(spark, blocks, monkeypatch):
    """Rows lie by key and bucket; only what is carried between buckets moves to them."""
    monkeypatch.setattr(long_documents, "BUCKET", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (rows, carry) = long_documents._by_length(blocks, None)[1]
        plan = long_documents.previous(rows, [long_documents.KEY], ["block_no"], F.col("page_num"), "page")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert carry and "isnull(__doc" not in plan and "coalesce(__doc" not in plan and "SortMergeJoin" in plan
