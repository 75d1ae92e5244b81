"""First occurrences and running numbers of images over a stream: state for each document outlives batches and restarts."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from docspark.operators.images import valid_size

IMAGE = "doc_id string, page_num int, idx bigint, image_hash string, width int, height int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Of one document: the hashes seen so far, each a key of its own in the state store, and how many images were kept."""

    def __init__(self, most: int | None):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "image_hash string", "image_no bigint")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        held = [part for part in rows if len(part)]
        if not held:
            return
        batch = pd.concat(held).sort_values(["page_num", "idx"], kind="stable").drop_duplicates("image_hash")
        n = self.count.get()[0] if self.count.exists() else 0
        kept = []
        for row in batch.itertuples(index=False):
            if self.most and n >= self.most:
                break
            if not self.seen.containsKey((row.image_hash,)):
                n += 1
                self.seen.updateValue((row.image_hash,), (n,))
                kept.append((*row, n))
        self.count.update((n,))
        if kept:
            yield pd.DataFrame(kept, columns=[*batch.columns, "image_no"])

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, within the block that starts a query."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def numbered(stream: DataFrame, most: int | None = None) -> DataFrame:
    """images.extract over a streaming table of IMAGE's columns: size filter, first occurrence of each hash of a document, running number.

    Order is that of arrival: micro-batch by micro-batch, and within one by page and place. So where a document's pages come in order,
    the result is the batch's; an image that comes late has a later number, and numbers once given stay. What a
    document brings in one micro-batch is held in memory, its state is not. Rows without a hash count as one image; a
    document id of null is a document.
    """
    out = StructType.fromDDL(f"{IMAGE}, image_no bigint")
    named = [f.split()[0] for f in IMAGE.split(", ")]
    rows = stream.filter(valid_size(F.col("width"), F.col("height"))).select(*named).withColumn("image_hash", F.coalesce("image_hash", F.lit("")))
    return rows.groupBy("doc_id").transformWithStateInPandas(FirstSeen(most), out, "Append", "None")


def run_once(stream: DataFrame, path: str, checkpoint: str, most: int | None = None) -> StreamingQuery:
    """Numbers what has come since the last run and appends it to the table at path; a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    with rocks_db(stream.sparkSession):
        return numbered(stream, most).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
