"""Image metadata: size filter, first-occurrence dedup, numbering, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import stem


def valid_size(width: Column, height: Column, least_width: int = 50, least_height: int = 50, least_area: int = 5000) -> Column:
    return (width >= least_width) & (height >= least_height) & (width.cast("bigint") * height >= least_area)


def first_occurrences(images: DataFrame) -> DataFrame:
    """The first image of each hash of a document, by page and place on it: a struct minimum, combined map-side."""
    rest = [c for c in images.columns if c not in ("doc_id", "image_hash", "page_num", "idx")]
    return images.groupBy("doc_id", "image_hash").agg(F.min(F.struct("page_num", "idx", *rest)).alias("first")).select("doc_id", "image_hash", "first.*")


def numbered(images: DataFrame, most: int | None = None) -> DataFrame:
    """Adds image_no, the running number of kept images of a document; with most (0 and None: no bound) the first ones only."""
    out = images.withColumn("image_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "idx")))
    return out.filter(F.col("image_no") <= most) if most else out


def kept(images: DataFrame, **sizes: int) -> DataFrame:
    """Size filter and dedup: what an extraction keeps, without numbers."""
    return first_occurrences(images.filter(valid_size(F.col("width"), F.col("height"), **sizes)))


def extract(images: DataFrame, most: int | None = None, **sizes: int) -> DataFrame:
    """Size filter, dedup, numbering, bound: the rows an extraction keeps."""
    return numbered(kept(images, **sizes), most)


def png_name(doc: Column, page: Column, number: Column) -> Column:
    """{document}_p{page}_img{number}.png, pages counted from 1."""
    return F.concat(stem(doc), F.lit("_p"), page.cast("string"), F.lit("_img"), number.cast("string"), F.lit(".png"))


def with_boxes(images: DataFrame, infos: DataFrame, pages: DataFrame) -> DataFrame:
    """bbox of the first info of (doc_id, page_num, xref), else the page's own rectangle."""
    keys = ["doc_id", "page_num", "xref"]
    first = infos.groupBy(*keys).agg(F.min_by("bbox", "info_no").alias("__box"))
    return images.join(first, keys, "left").join(pages.select("doc_id", "page_num", "rect"), ["doc_id", "page_num"], "left").withColumn("bbox", F.coalesce("__box", "rect")).drop("__box", "rect")


def summary(images: DataFrame) -> DataFrame:
    """One row: count, pages (counted from 1), truncated mean sizes, total area; nulls for sizes without images."""
    page = F.col("page_num") + 1
    return images.agg(
        F.count("*").alias("total_images"),
        F.count_distinct("page_num").alias("pages_with_images"),
        F.array_join(F.sort_array(F.collect_set(page)), ",").alias("pages"),
        F.avg("width").cast("int").alias("avg_width"),
        F.avg("height").cast("int").alias("avg_height"),
        F.sum(F.col("width").cast("bigint") * F.col("height")).alias("total_pixels"),
    )


def sizes(images: DataFrame) -> DataFrame:
    """(doc_id, sizes): each document's sizes in order."""
    item = F.struct("page_num", "idx", F.concat_ws("x", "width", "height").alias("size"))
    return images.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["size"]).alias("sizes"))


def split_kinds(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Charts, and everything else."""
    chart = F.col("block_type").eqNullSafe(F.lit("chart"))
    return classified.filter(chart), classified.filter(~chart)


def count_kinds(classified: DataFrame) -> DataFrame:
    return classified.agg(F.count_if(F.col("block_type") == "chart").alias("charts"), F.count_if(F.col("block_type") == "image").alias("images"))
