"""Tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where that is unset and all runs on one machine, an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        found = f"file://{tempfile.gettempdir()}/docspark-shared-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docspark/{name}-{uuid.uuid4().hex}"
    for paths in _open[-1:]:
        paths.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that operators have left in the shared folder within the block, when it ends. A lazy result
    that still reads them has to be written within the block, to a path from outside."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Whether Spark removes a query's shuffle files as soon as it has ended, and not when the driver next collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within the block the session has these settings."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shuffles_removed(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within the block no query leaves shuffle files behind, so what many rounds hold on disk is one round's. Tables that
    queries share there have to be stashed."""
    return settings(spark, {CLEAN_UP: "true"})


def stash(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(*tables: DataFrame) -> None:
    """Removes the files behind stashed tables that nothing reads any more."""
    for df in tables:
        for folder in {os.path.dirname(x) for x in df.inputFiles()}:
            if "/docspark/" in folder:
                _remove(df.sparkSession, folder)
