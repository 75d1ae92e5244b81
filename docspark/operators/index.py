"""The vector index: one Parquet table of chunks with unit vectors, a folder for each write."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.text import let
from docspark.functions.vectors import norm, unit

INDEX = "row_id bigint, source string, chunk_id string, text string, type string, page int, section string, vec array<double>"


def normalised(df: DataFrame, vec: str = "vec", dim: int | None = None) -> DataFrame:
    """df with vec over its length, in double precision; a wrong dimension raises when it is read."""
    v = F.col(vec)
    if dim is not None:
        v = F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"vectors have {dim} dimensions, not "), F.size(v).cast("string"))))
    # Bound once each: filters and other columns over vec would have the length worked out again for every component.
    return df.withColumn(vec, let(v, lambda x: let(norm(x), lambda n: unit(x, n))))


def write(chunks: DataFrame, path: str, mode: str = "overwrite", dim: int | None = None, part: str | None = None) -> None:
    """Saves chunks (source, chunk_id, …, vec). The row id hangs on the key alone, so appends and repeated tasks agree.

    A write is one folder, whatever the number of sources; within it rows are sorted by source, and files carry filters
    over it, so that a search of one source skips the others. With `part` a write has a name, and replaces what an
    earlier one of that name has left, as a micro-batch that runs again has to.
    """
    rows = normalised(chunks, dim=dim).withColumn("row_id", F.xxhash64("source", "chunk_id"))
    named = rows.withColumn("part", F.lit(part or uuid.uuid4().hex)).sortWithinPartitions("source", "row_id")
    writer = named.write.partitionBy("part").option("parquet.bloom.filter.enabled#source", "true")
    if part is not None:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode(mode).parquet(path)


def append(chunks: DataFrame, path: str, dim: int | None = None) -> None:
    write(chunks, path, "append", dim)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The index at path; FileNotFoundError where there is none."""
    try:
        return spark.read.parquet(path).drop("part")
    except AnalysisException as e:
        raise FileNotFoundError(path) from e


def clear(spark: SparkSession, path: str) -> None:
    """Leaves an index without rows, to which others may be appended."""
    none = spark.createDataFrame([], INDEX)
    none.withColumn("part", F.lit("")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(path)
    none.coalesce(1).write.mode("overwrite").parquet(f"{path}/part=none")


def size(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("index_size"), F.max(F.size("vec")).alias("embedding_dim"))
