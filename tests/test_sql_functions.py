import pytest
from pyspark.sql import functions as F

from docspark.functions import metrics
from docspark.operators import chunking, layout
from docspark.plans import queries as core
from docspark.plans import sql_functions

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "  ", "a", "ОТЧЁТ 2024", "it's \\ 'quoted':", "• item", "3) item", "1 2 3 4 5 6", "plain text that says little", "\x0bABC\xa0", "²) x", "ǅ ABC", "# T\n\none. two.\n\n## U ##\n| a | b | c |\n*Страница 12*\n### V", "![x](y.png)\n*Страница 99999999999*", "first.  second! " * 9 + "\n\nshort\n\n" + "long. " * 12]


@pytest.fixture(scope="module")
def texts(spark):
    return sql_functions.register(sql_functions.register(spark)).createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")


def same(left, right):
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(left) == rows(right) and left.columns == right.columns


def test_values(spark, texts):
    got = spark.sql("SELECT id, block_type(text) AS a, section_type(text) AS b, page_mark(text) AS c FROM {texts}", texts=texts)
    same(got, texts.select("id", layout.classify(F.col("text")).alias("a"), chunking.section_type(F.col("text")).alias("b"), chunking.page_number(F.col("text")).alias("c")))
    pairs = texts.select("id", F.col("text").alias("answer"), F.lit("a plain item says abc").alias("context"))
    same(spark.sql("SELECT id, faithfulness(answer, context) AS f FROM {pairs}", pairs=pairs), pairs.select("id", metrics.faithfulness(F.col("answer"), F.col("context")).alias("f")))


@pytest.mark.parametrize(("most", "overlap"), [(1000, 100), (60, 0), (60, 7), (10, 3)])
def test_arrays(spark, texts, most, overlap):
    got = spark.sql("SELECT id, markdown_sections(text) AS sections, sub_chunks(text, {most}, {overlap}) AS parts FROM {texts} WHERE text IS NOT NULL", texts=texts, most=most, overlap=overlap)
    want = chunking.with_sections(texts.filter("text is not null"), "text").withColumn("parts", chunking.sub_chunks(F.col("text"), most, overlap))
    same(got, want.drop("text"))


@pytest.mark.parametrize("name", ["block_classify", "chunk_sections", "faithfulness"])
def test_queries_as_text(spark, name):
    query = core.queries()[f"{name}_sql"](spark, SF)
    want = core.queries()[name](spark, SF)
    same(query.select(*want.columns), want)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_filters_reach_the_scan(spark):
    plan = core.queries()["block_classify_sql"](spark, SF).filter("doc_id = 3").select("block_no")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,3)" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
