"""Queries that run a stream to its end and return what it left."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.images import png_name
from docspark.plans import queries as core
from docspark.plans.shared import new_path
from docspark.streaming import images, ingest


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    if "://" in sf_dir or os.path.isdir(path):
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of block types, read when the stream has ended."""
    name = f"type_counts_{uuid.uuid4().hex}"
    query = ingest.type_counts(read_stream(spark, sf_dir, "documents")).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.table(name)


def stream_dedup_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of dedup_limit_number as a stream that is stopped and started again between its pages' arrivals."""
    pages, out, checkpoint = (new_path(spark, x) for x in ("arrivals", "numbered", "stream"))
    rows = core.pictures(spark, sf_dir).select(*[f.split()[0] for f in images.IMAGE.split(", ")])
    for begin, end in ((0, 3), (3, 7), (7, 10)):
        rows.filter(F.col("page_num").between(begin, end - 1)).write.mode("append").parquet(pages)
        query = images.run_once(spark.readStream.schema(images.IMAGE).parquet(pages), out, checkpoint, 20)
        try:
            query.awaitTermination()
        finally:
            query.stop()
    kept = spark.read.schema(f"{images.IMAGE}, image_no bigint, batch int").parquet(out)
    name = png_name(F.concat(F.lit("/data/"), "doc_id", F.lit(".pdf")), F.col("page_num") + 1, F.col("image_no"))
    return kept.select("doc_id", "idx", F.col("image_no").cast("int").alias("image_no"), name.alias("file_name"))


def queries() -> dict:
    return {"stream_type_counts": stream_type_counts, "stream_dedup_number": stream_dedup_number}
