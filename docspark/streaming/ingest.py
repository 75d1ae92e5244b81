"""Streams of documents into the index: the batch plan, micro-batch by micro-batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.operators import index, layout
from docspark.plans.pipeline import Pipeline


def stream_into_index(docs: DataFrame, pipeline: Pipeline, checkpoint: str, once: bool = True) -> StreamingQuery:
    """docs: a streaming (doc_id, text). Row ids hang on the key alone, and a micro-batch is written under a name of its
    own, so a batch that runs again after a failure replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        own = hashlib.md5(checkpoint.encode()).hexdigest()  # noqa: S324
        index.write(pipeline.chunks(layout.line_blocks(batch)), pipeline.path, dim=pipeline.dim, part=f"stream-{own}-{number}")

    stream = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def type_counts(docs: DataFrame) -> DataFrame:
    """Running counts of block types of a stream of documents."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    return lines.groupBy(layout.classify(F.col("text")).alias("block_type")).agg(F.count("*").alias("n"))
