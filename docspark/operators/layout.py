"""Page parsing and block classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import DIGIT, DIGIT_FAST, count_of, is_upper, strip, text_of

# The marks that begin a list item.
BULLETS = "•–—▪►●-"


def looks_like_table(t: Column) -> Column:
    """At least four digits and five spaces."""
    return (count_of(t, DIGIT_FAST) >= 4) & (count_of(t, " ") >= 5)


def classify(text: Column) -> Column:
    """header, list, table, text or no_text; the order of the rules matters."""
    t = strip(text_of(text))
    n = F.length(t)
    return (
        F.when(n < 3, "no_text")
        .when((n < 80) & is_upper(t), "header")
        .when((n < 60) & t.endswith(":"), "header")
        .when(t.rlike(f"^[{BULLETS}]"), "list")
        .when(t.rlike(f"^{DIGIT}[.)]"), "list")
        .when(looks_like_table(t), "table")
        .otherwise("text")
    )


def span_text(lines: Column) -> Column:
    """Text of array<struct<spans: array<struct<text>>>>, spans joined by single spaces."""
    return F.array_join(F.flatten(F.transform(lines, lambda line: F.transform(line["spans"], lambda s: s["text"]))), " ")


def parse_blocks(raw: DataFrame) -> DataFrame:
    """Raw page blocks (type 0 text, 1 image, others ignored) to typed blocks; empty text blocks go."""
    text = strip(text_of(span_text(F.col("lines"))))
    out = raw.filter(F.col("type").isin(0, 1)).withColumn("text", F.when(F.col("type") == 0, text))
    out = out.filter((F.col("type") == 1) | (F.col("text") != ""))
    return out.withColumn("block_type", F.when(F.col("type") == 0, classify(F.col("text"))).otherwise("no_text")).drop("lines", "type")


def line_blocks(docs: DataFrame, lines_per_page: int = 20) -> DataFrame:
    """Blocks from plain text: a block for each line, pages of lines_per_page lines."""
    lines = docs.select("doc_id", F.posexplode(F.split(text_of(F.col("text")), "\n")).alias("block_no", "text"))
    return lines.select("doc_id", "block_no", (F.floor(F.col("block_no") / lines_per_page) + 1).cast("int").alias("page_num"), classify(F.col("text")).alias("block_type"), "text")


def count_types(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block_type").agg(F.count("*").alias("n"))


def first_of_each_type(blocks: DataFrame, *order: str) -> DataFrame:
    """The first block with text of each type: one struct per type, combined map-side."""
    rest = [c for c in blocks.columns if c not in order and c != "block_type"]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return blocks.filter(text_of(F.col("text")) != "").groupBy("block_type").agg(first).select("block_type", "first.*")


def page_window() -> Window:
    return Window.partitionBy("doc_id").orderBy("block_no")
