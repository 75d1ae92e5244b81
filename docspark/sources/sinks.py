"""Sinks for Markdown and benchmark results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_markdown(docs: DataFrame, path: str) -> None:
    """(doc_id, markdown) as a Parquet table, of as many files as the plan has tasks."""
    docs.select("doc_id", "markdown").write.mode("overwrite").parquet(path)


def export_markdown(docs: DataFrame, folder: str) -> DataFrame:
    """Writes {doc_id}.md for each of (doc_id, markdown) under folder, which all workers must reach, and returns (doc_id, saved_path)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for frame in frames:
            paths = [f"{base}/{d.rsplit('/', 1)[-1]}.md" for d in frame["doc_id"]]
            for path, text in zip(paths, frame["markdown"].fillna(""), strict=True):  # a repeated task writes the same again
                with store.open_output_stream(path) as out:
                    out.write(text.encode())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "saved_path": paths})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "markdown").mapInPandas(run, "doc_id string, saved_path string")


def report_json(results: DataFrame) -> DataFrame:
    """One row: {timestamp, num_questions, results} as indented JSON, for a report that one value can hold."""
    item = F.struct(*results.columns)
    body = F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.count("*").alias("num_questions"), F.array_sort(F.collect_list(item)).alias("results"))
    return results.agg(F.to_json(body, {"pretty": "true"}).alias("value"))


def write_results(results: DataFrame, path: str) -> None:
    """Any number of results as JSON lines under path/results, and {timestamp, num_questions} under path/report."""
    results.write.mode("overwrite").json(f"{path}/results")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")
    results.agg(F.count("*").alias("num_questions")).select(stamp, "num_questions").coalesce(1).write.mode("overwrite").json(f"{path}/report")
