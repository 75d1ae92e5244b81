import random

import pytest

from docspark.operators import images as batch
from docspark.streaming import images


def made(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), page, i, rng.choice(["h%d" % rng.randint(0, 25), None]), rng.choice([40, 80, 200]), 90) for page in range(6) for i in range(n)]
    return rows + rows[:5]  # repeated rows


@pytest.mark.parametrize("most", [None, 4])
def test_stream_stopped_between_arrivals_equals_batch(spark, tmp_path, most):
    rows = spark.createDataFrame(made(1, 40), images.IMAGE)
    pages, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("pages", "out", "checkpoint"))
    for begin, end in ((0, 1), (1, 4), (4, 6)):
        rows.filter(f"page_num >= {begin} and page_num < {end}").repartition(3).write.mode("append").parquet(pages)
        query = images.run_once(spark.readStream.schema(images.IMAGE).parquet(pages), out, checkpoint, most)
        query.awaitTermination()
    images.run_once(spark.readStream.schema(images.IMAGE).parquet(pages), out, checkpoint, most).awaitTermination()  # nothing new
    key = ("doc_id", "page_num", "idx", "image_hash", "image_no")
    got = spark.read.parquet(out).select(*key).collect()
    want = batch.extract(rows.fillna({"image_hash": ""}), most).select(*key).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_late_images_keep_earlier_numbers(spark, tmp_path):
    pages, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("pages", "out", "checkpoint"))
    for part in ([("d", 5, 0, "x", 100, 100)], [("d", 1, 0, "y", 100, 100), ("d", 1, 1, "x", 100, 100), ("d", 1, 2, "small", 10, 10)]):
        spark.createDataFrame(part, images.IMAGE).write.mode("append").parquet(pages)
        images.run_once(spark.readStream.schema(images.IMAGE).parquet(pages), out, checkpoint).awaitTermination()
    assert sorted((r.image_hash, r.image_no) for r in spark.read.parquet(out).collect()) == [("x", 1), ("y", 2)]
    assert spark.conf.get(images.PROVIDER) != images.ROCKS
