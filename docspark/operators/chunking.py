"""Markdown to sections to chunks, row by row: no shuffle, folds over arrays within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import SPACE, let, preview, strip, text_of

NO_TITLE = "Без заголовка"
IMAGE_SECTION = "Изображения и графики"
HEADING = rf"(?d)^(#{{1,3}}){SPACE}+(.+)$"


def with_sections(df: DataFrame, markdown: str = "markdown", name: str = "sections") -> DataFrame:
    """Adds array<struct<title, body>>: a section for each heading of level one to three that has a line below it.

    A column for each step, since an expression named in a lambda is worked out for each element.
    """
    lines = F.split(text_of(F.col(markdown)), "\n")
    at = F.filter(F.transform("__lines", lambda line, i: F.when(line.rlike(HEADING), i)), lambda i: i.isNotNull())
    last = F.size("__lines")
    found = F.transform(
        F.concat(F.array(F.lit(-1)), F.col("__at")),
        lambda a, k: F.struct(
            F.when(a < 0, F.lit(NO_TITLE)).otherwise(strip(F.regexp_extract(F.get("__lines", a), HEADING, 2))).alias("title"),
            F.slice("__lines", a + 2, F.coalesce(F.get("__at", k), last) - a - 1).alias("lines"),
        ),
    )
    full = F.transform(F.filter(found, lambda s: F.size(s["lines"]) > 0), lambda s: F.struct(s["title"], F.array_join(s["lines"], "\n").alias("body")))
    return df.withColumn("__lines", lines).withColumn("__at", at).withColumn(name, full).drop("__lines", "__at")


def is_table(body: Column) -> Column:
    return body.rlike(r"(?d)\|.*\|.*\|")


def is_image(body: Column) -> Column:
    return body.rlike(r"(?d)!\[.*\]\(.*\)")


def section_type(body: Column) -> Column:
    return F.when(is_table(body), "table").when(is_image(body), "image_caption").otherwise("text")


def page_number(body: Column) -> Column:
    """The first page mark's number, or null."""
    return F.nullif(F.regexp_extract(body, rf"\*Страница{SPACE}+(\d+)\*", 1), F.lit("")).try_cast("int")


def _state(out: Column, cur: Column) -> Column:
    return F.struct(out.alias("out"), cur.alias("cur"))


def _empty() -> Column:
    return _state(F.array().cast("array<string>"), F.lit(""))


def _flushed(s: Column) -> Column:
    """What has been packed, with what is being packed."""
    return F.when(s["cur"] == "", s["out"]).otherwise(F.array_append(s["out"], s["cur"]))


def _grown(s: Column, x: Column, gap: str) -> Column:
    return _state(s["out"], F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit(gap), x)))


def sentences(text: Column, most: int) -> Column:
    """Sentences packed up to `most` characters; a longer one stays whole."""
    over = lambda s, x: F.length(s["cur"]) + F.length(x) + 1 > most
    return F.aggregate(F.split(text, rf"(?<=[.!?]){SPACE}+"), _empty(), lambda s, x: F.when(over(s, x), _state(_flushed(s), x)).otherwise(_grown(s, x, " ")), _flushed)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def sub_chunks(body: Column, most: int, overlap: int) -> Column:
    """Paragraphs packed up to `most` characters; a chunk begins with the last `overlap` characters of the one before.

    A paragraph that is too long by itself is split by sentences, but only where nothing stands before it.
    """

    def step(s: Column, p: Column) -> Column:
        cur, out = s["cur"], s["out"]
        carried = F.concat(F.right(cur, F.lit(overlap)), F.lit("\n\n"), p) if overlap > 0 else p
        over = F.length(cur) + F.length(p) + 2 > most
        return (
            F.when(over & (cur != ""), _state(F.array_append(out, cur), carried))
            .when(over, let(sentences(p, most), lambda x: _state(F.concat(out, F.slice(x, F.lit(1), F.size(x) - 1)), F.element_at(x, -1))))
            .otherwise(_grown(s, p, "\n\n"))
        )

    packed = F.aggregate(paragraphs(body), _empty(), step, _flushed)
    return F.when(F.length(body) <= most, F.array(body)).otherwise(packed)


def chunk_id(*key: Column) -> Column:
    """Eight hex digits that depend on the key alone, so a repeated task gives the same."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[k.cast("string") for k in key]), 256), 1, 8)


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, title, body, page, type) of (doc_id, markdown)."""
    rows = with_sections(docs).select("doc_id", F.posexplode("sections").alias("section_no", "s")).select("doc_id", "section_no", "s.title", "s.body")
    return rows.withColumn("page", page_number(F.col("body"))).withColumn("type", section_type(F.col("body")))


def chunk_markdown(docs: DataFrame, most: int = 1000, overlap: int = 100, least: int = 50) -> DataFrame:
    """(chunk_id, doc_id, section_no, chunk_no, text, type, page, section) of (doc_id, markdown)."""
    pieces = sections(docs).select("doc_id", "section_no", "title", "page", "type", F.posexplode(sub_chunks(F.col("body"), most, overlap)).alias("chunk_no", "raw"))
    kept = pieces.withColumn("text", strip(F.col("raw"))).filter(F.length("text") >= least)
    return kept.select(chunk_id(F.col("doc_id"), F.col("section_no"), F.col("chunk_no")).alias("chunk_id"), "doc_id", "section_no", "chunk_no", "text", "type", "page", F.col("title").alias("section"))


def chunk_simple(docs: DataFrame, most: int = 1000, least: int = 50, text: str = "text") -> DataFrame:
    """Paragraphs packed without overlap; only the last chunk of a document has to be `least` long."""
    packed = F.aggregate(
        paragraphs(text_of(F.col(text))),
        _empty(),
        lambda s, p: F.when(F.length(s["cur"]) + F.length(p) + 2 > most, _state(_flushed(s), p)).otherwise(_grown(s, p, "\n\n")),
        lambda s: F.when(F.length(strip(s["cur"])) >= least, F.array_append(s["out"], s["cur"])).otherwise(s["out"]),
    )
    rows = docs.select("doc_id", F.posexplode(packed).alias("chunk_no", "raw"))
    return rows.select(chunk_id(F.col("doc_id"), F.lit("simple"), F.col("chunk_no")).alias("chunk_id"), "doc_id", "chunk_no", strip(F.col("raw")).alias("text"), F.lit("text").alias("type"))


def chart_text(chart: Column) -> Column:
    """What a chart is indexed by."""
    said, ocr = text_of(chart["gpt_description"]), text_of(chart["ocr_text"])
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[Тип: "), chart["chart_subtype_ru"], F.lit("] [Стр. "), chart["page_num"].cast("string"), F.lit("]")),
        F.when(said != "", F.concat(F.lit("Описание: "), said)),
        F.when(ocr != "", F.concat(F.lit("Текст на изображении: "), preview(ocr, 300))),
    )


def image_chunk(text: Column, page: Column, section: Column | None = None, source: Column | None = None) -> Column:
    """The struct of one image chunk; an empty section has the default's name."""
    own = F.coalesce(F.nullif(section, F.lit("")), F.lit(IMAGE_SECTION)) if section is not None else F.lit(IMAGE_SECTION)
    where = source if source is not None else F.lit(None).cast("string")
    return F.struct(chunk_id(where, page, text).alias("chunk_id"), text.alias("text"), F.lit("image_caption").alias("type"), page.alias("page"), own.alias("section"), where.alias("source"))


def image_chunks(charts: DataFrame, source: str = "unknown", least: int = 50) -> DataFrame:
    """Chunks of chart analyses; short ones go, and text stays as it is."""
    rows = charts.withColumn("__text", chart_text(F.struct(*charts.columns))).filter(F.length(strip(F.col("__text"))) >= least)
    return rows.select(image_chunk(F.col("__text"), F.col("page_num"), source=F.lit(source)).alias("c")).select("c.*")


def stats(chunks: DataFrame) -> DataFrame:
    n = F.length("text")
    return chunks.agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"))


def histogram(chunks: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, n): equal widths between the shortest and the longest chunk; the longest lies in the last bin."""
    n = F.length("text")
    ends = chunks.agg(F.min(n).alias("low"), F.max(n).alias("high"))  # one row
    placed = chunks.select(n.alias("len")).join(F.broadcast(ends), F.lit(True))
    at = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("len") - F.col("low")) * bins / (F.col("high") - F.col("low")))))
    return placed.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
