"""Benchmarks of answers: metrics for each question, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import metrics

# The sample questions with their reference answers.
SAMPLE = [
    ("О чём этот документ?", "Документ описывает основную информацию и содержание представленного PDF файла.", "general"),
    ("Какие основные разделы содержит документ?", "Документ содержит несколько разделов с различной тематикой.", "structure"),
    ("Есть ли в документе таблицы? Если да, что в них?", "В документе могут присутствовать таблицы с данными.", "multimodal"),
]


def sample_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(SAMPLE)], "query_id bigint, question string, reference string, category string")


def evaluate(rows: DataFrame) -> DataFrame:
    """Adds bleu, rouge_l and faithfulness to (reference, answer, context_used)."""
    return rows.withColumns(
        {
            "bleu": metrics.bleu(F.col("reference"), F.col("answer")),
            "rouge_l": metrics.rouge_l(F.col("reference"), F.col("answer")),
            "faithfulness": metrics.faithfulness(F.col("answer"), F.coalesce("context_used", F.lit(""))),
        }
    )


def run(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """(question, reference, answer of 200 characters, category, model, metrics) of pairs and answers by query_id."""
    joined = pairs.join(answers.select("query_id", "answer", "model", "context_used"), "query_id")
    done = evaluate(joined).withColumn("answer", F.substring("answer", 1, 200))
    return done.select("question", "reference", "answer", F.coalesce("category", F.lit("unknown")).alias("category"), "model", "bleu", "rouge_l", "faithfulness")


def summary(results: DataFrame) -> DataFrame:
    """One row of means; null without results."""
    return results.agg(F.count("*").alias("questions"), *(F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("bleu", "rouge_l", "faithfulness")))
