"""A ledger of what an endpoint has said, by the hash of the request, so that a repeated stage sends no prompt again.

Distinct prompts that the ledger lacks are dealt by hash to `tasks` tasks, so at most tasks x concurrency calls are under
way. A task writes what was said to each FLUSH prompts as a file of its own before it sends more; when it is lost, its
next attempt reads the files of the one before and goes on behind them, and a stage that starts anew reads the whole
ledger. What was sent since the last file, at most FLUSH prompts a task, is sent again with the same idempotency key.
Failed calls aren't entered. Two attempts that run at once (speculation) may both send; one answer is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prompts of a task between two files.
FLUSH = 64
ENTRY = "request string, said string"


def request_hash(endpoint, before: list[dict], prompt: Column) -> Column:
    """The key of a request: the model and its settings, the messages before, and the prompt; null for a null prompt."""
    rest = json.dumps(endpoint.body(before, ""), sort_keys=True, ensure_ascii=False)
    return F.sha2(F.concat(F.lit(rest + "\n"), prompt), 256)


def entries(spark: SparkSession, ledger: str) -> DataFrame:
    """(request, said) of all files of a ledger, one row a request; empty before the first stage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("recursiveFileLookup", "true").parquet(ledger).groupBy("request").agg(F.min("said").alias("said"))


def answered(ready: DataFrame, endpoint, before: list[dict], ledger: str, tasks: int = 16) -> DataFrame:
    """ready with __said in the place of __prompt; a row without a prompt, or whose call failed, has null."""
    spark = ready.sparkSession
    keyed = ready.withColumn("__request", request_hash(endpoint, before, F.col("__prompt")))
    wanted = keyed.filter("__prompt is not null").groupBy(F.col("__request").alias("request")).agg(F.first("__prompt").alias("prompt"))
    open_ = wanted.join(entries(spark, ledger).select("request"), "request", "left_anti").repartition(tasks, "request")
    open_.mapInArrow(_sender(endpoint, before, f"{ledger.rstrip('/')}/{uuid.uuid4().hex}"), "request string").write.format("noop").mode("overwrite").save()
    said = entries(spark, ledger).select(F.col("request").alias("__request"), F.col("said").alias("__said"))
    return keyed.join(said, "__request", "left").drop("__request", "__prompt")


def _sender(endpoint, before: list[dict], folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        mine = f"part-{task.partitionId():05d}-"
        files = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.startswith(mine)]
        known = {r for f in files for r in parquet.read_table(f, filesystem=store).column("request").to_pylist()}
        for n, batch in enumerate(batches):
            rows = [r for r in zip(*(c.to_pylist() for c in batch.columns), strict=True) if r[0] not in known]
            for at in range(0, len(rows), FLUSH):
                part = rows[at : at + FLUSH]
                said = endpoint.send_all(before, [prompt for _, prompt in part])
                got = [(request, s) for (request, _), s in zip(part, said, strict=True) if s is not None]
                if got:
                    name = f"{mine}{task.attemptNumber()}-{n:05d}-{at:07d}.parquet"
                    made = pa.table([pa.array(c, pa.string()) for c in zip(*got, strict=True)], names=["request", "said"])
                    parquet.write_table(made, f"{base}/_{name}", filesystem=store)  # names with _ aren't read
                    store.move(f"{base}/_{name}", f"{base}/{name}")
                    yield pa.RecordBatch.from_arrays([made.column("request").combine_chunks()], names=["request"])

    return run
