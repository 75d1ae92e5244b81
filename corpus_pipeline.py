"""A corpus pipeline: quality classifier, language ID, exact dedup, n-gram Jaccard join, packing.

Each stage takes all rows its predecessor kept; all but the last return the columns of documents. The classifier and
the language model learn only from the rows that their queries may learn from.

Defined cases: a null text goes as a text without quality or language does, and rows without an id are judged by their
text; of rows that repeat an id and text one stays; texts of any length are judged and packed whole; an empty table
gives an empty result at every stage; extra columns, whatever their names and types, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import exact_dedup, language_id, ngram_join, packing, quality_classifier
from docspark.llm.common import table, with_workers
from docspark.llm.queries import language_model, quality_model, tokenizer_files
from docspark.plans.shared import drop_stash, new_path, scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_workers(spark)
    return quality_classifier.keep_good(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_workers(spark)
    return language_id.keep_known(docs, language_model(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_workers(spark)
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_workers(spark)
    return packing.pack(docs, **tokenizer_files())


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_languages),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]

#: The classifiers and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"stage{k}")
        with scratch(spark):  # what a stage has left behind goes once its result is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if k:
            drop_stash(docs)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
