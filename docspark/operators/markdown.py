"""Blocks to Markdown. A block renders to an array of lines; a document is its blocks' lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import DIGIT, let, preview, split_spaces, strip, text_of
from docspark.operators.layout import BULLETS, page_window

LINES = "array<string>"


def header_lines(text: Column) -> Column:
    return F.array(F.concat(F.lit("## "), strip(text)), F.lit(""))


def text_lines(text: Column) -> Column:
    return F.array(strip(text), F.lit(""))


def list_item(text: Column) -> Column:
    """The item without its mark; then, too, without a digit and its point."""
    bare = strip(F.regexp_replace(strip(text), f"^[{BULLETS}]", ""))
    return F.when((F.length(bare) > 2) & bare.rlike(f"^{DIGIT}[.)]"), strip(F.substr(bare, F.lit(3)))).otherwise(bare)


def list_lines(text: Column) -> Column:
    return F.array(F.concat(F.lit("- "), list_item(text)))


def table_cells(row: Column) -> Column:
    """Cells between tabs, or else between runs of two spaces or more; empty ones go."""
    cells = F.when(row.contains("\t"), F.split(row, "\t")).otherwise(split_spaces(strip(row)))
    return F.filter(F.transform(cells, strip), lambda c: c != "")


def table_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_lines(text: Column) -> Column:
    """Header, rule and rows, each row as wide as the header."""
    padded = lambda row, width: table_line(F.slice(F.concat(table_cells(row), F.array_repeat(F.lit(""), width)), F.lit(1), width))
    whole = lambda rows, head: F.concat(
        F.array(F.lit(""), table_line(head), table_line(F.array_repeat(F.lit("---"), F.size(head)))),
        F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda row: padded(row, F.size(head))),
        F.array(F.lit("")),
    )
    return let(F.split(strip(text), "\n"), lambda rows: let(table_cells(F.element_at(rows, 1)), lambda head: whole(rows, head)))


def _when(condition: Column, *lines: Column) -> Column:
    return F.when(condition, F.array(*lines)).otherwise(F.array().cast(LINES))


def chart_lines(chart: Column, page: Column) -> Column:
    """Heading, link, transcription and recognised text, as far as there are any."""
    kind = F.coalesce(chart["chart_subtype_ru"], F.lit("График"))
    path, said, ocr = (text_of(chart[k]) for k in ("image_path", "gpt_description", "ocr_text"))
    blank = F.lit("")
    return F.concat(
        F.array(F.concat(F.lit("### [График: "), kind, F.lit("]")), blank),
        _when(path != "", F.concat(F.lit("!["), kind, F.lit(", стр. "), page.cast("string"), F.lit("]("), path, F.lit(")")), blank),
        _when(said != "", F.concat(F.lit("**Транскрипция:** "), said), blank),
        _when(ocr != "", F.concat(F.lit("*OCR-текст:* "), preview(ocr, 200)), blank),
    )


def image_lines(image: Column, page: Column) -> Column:
    path, ocr = text_of(F.coalesce(image["image_path"], image["path"])), text_of(image["ocr_text"])
    where = F.concat(F.lit("Изображение со стр. "), page.cast("string"))
    link = F.when(path != "", F.concat(F.lit("!["), where, F.lit("]("), path, F.lit(")"))).otherwise(F.concat(F.lit("*["), where, F.lit("]*")))
    return F.concat(F.array(link), _when(ocr != "", F.concat(F.lit("*Текст на изображении:* "), preview(ocr, 100))), F.array(F.lit("")))


def block_lines(kind: Column, text: Column, page: Column, chart: Column | None = None, image: Column | None = None) -> Column:
    """Lines of one block; no_text renders nothing, an unknown type like text."""
    nothing = F.array().cast(LINES)
    out = F.when(kind == "no_text", nothing)
    if chart is not None:
        out = out.when(kind == "chart", chart_lines(chart, page))
    if image is not None:
        out = out.when(kind == "image", image_lines(image, page))
    out = out.when(text_of(text) == "", nothing)
    return out.when(kind == "header", header_lines(text)).when(kind == "list", list_lines(text)).when(kind == "table", table_lines(text)).otherwise(text_lines(text))


def build(blocks: DataFrame, source: Column | None = None) -> DataFrame:
    """(doc_id, markdown) from (doc_id, block_no, page_num, block_type, text[, chart, image, source]).

    One shuffle by document: the page before is a window, and the ordered lines an aggregate, over the same keys.
    """
    own = {c: F.col(c) if c in blocks.columns else None for c in ("chart", "image")}
    mark = F.when(F.col("page_num").eqNullSafe(F.lag("page_num").over(page_window())), F.array().cast(LINES)).otherwise(
        F.array(F.concat(F.lit("\n---\n*Страница "), F.coalesce(F.col("page_num").cast("string"), F.lit("None")), F.lit("*\n")))
    )
    lines = F.concat(mark, block_lines(F.col("block_type"), F.col("text"), F.col("page_num"), **own))
    title = source if source is not None else F.col("doc_id").cast("string")
    rows = blocks.select("doc_id", title.alias("__title"), F.struct("block_no", lines.alias("lines")).alias("part"))
    whole = rows.groupBy("doc_id").agg(F.first("__title").alias("title"), F.array_sort(F.collect_list("part")).alias("parts"))
    body = F.flatten(F.transform("parts", lambda p: p["lines"]))
    return whole.select("doc_id", F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.col("title")), F.lit("")), body), "\n").alias("markdown"))
