"""What Python workers need from the session."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def with_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where the driver found it on sys.path only (local runs; a cluster gets
    --py-files), and bounds the bytes of a batch, since rows may hold long texts or blocks of vectors."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark
