"""Rendering and chunking against plain restatements of the rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.operators import chunking, markdown

options = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
BLOCKS = "doc_id bigint, block_no int, page_num int, block_type string, text string, chart struct<chart_subtype_ru:string,gpt_description:string,ocr_text:string,image_path:string>, image struct<image_path:string,path:string,ocr_text:string>"


def test_build(spark):
    rows = [
        (1, 0, 1, "header", " HEAD ", None, None), (1, 1, 1, "text", "para", None, None), (1, 2, 2, "no_text", "x", None, None), (1, 3, 2, "list", "• item", None, None),
        (1, 4, 2, "table", "a  b", None, None), (1, 5, 1, "chart", "unused", ("Гистограмма", "said", "o" * 201, "p.png"), None), (1, 6, 1, "chart", None, (None, "", None, None), None),
        (1, 7, 3, "image", None, None, (None, "q.png", "t" * 101)), (1, 8, 3, "image", None, None, (None, None, "")), (1, 9, 3, "text", "", None, None), (1, 10, 3, "odd", "like text", None, None), (2, 0, None, "text", "no page", None, None),
    ]
    got = {r.doc_id: r.markdown for r in markdown.build(spark.createDataFrame(rows[::-1], BLOCKS)).collect()}
    mark = lambda n: f"\n---\n*Страница {n}*\n"
    assert got[1] == "\n".join(
        ["# 1", "", mark(1), "## HEAD", "", "para", "", mark(2), "- item", "", "| a | b |", "| --- | --- |", "", mark(1), "### [График: Гистограмма]", "", "![Гистограмма, стр. 1](p.png)", "", "**Транскрипция:** said", ""]
        + ["*OCR-текст:* " + "o" * 200 + "...", "", "### [График: График]", "", mark(3), "![Изображение со стр. 3](q.png)", "*Текст на изображении:* " + "t" * 100 + "...", "", "*[Изображение со стр. 3]*", "", "like text", ""]
    )
    assert got[2] == "# 2\n\nno page\n"


def sections(text):
    out, title, body = [], "Без заголовка", []
    for line in text.split("\n"):
        m = re.match(r"^(#{1,3})\s+(.+)$", line)
        if m:
            if body:
                out.append((title, "\n".join(body)))
            title, body = m[2].strip(), []
        else:
            body.append(line)
    return [*out, (title, "\n".join(body))] if body else out


def sentences(text, most):
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len(cur) + len(s) + 1 > most:
            out += [cur] if cur else []
            cur = s
        else:
            cur = f"{cur} {s}" if cur else s
    return [*out, cur] if cur else out


def sub_chunks(text, most, overlap):
    if len(text) <= most:
        return [text]
    out, cur = [], ""
    for p in filter(None, (p.strip() for p in text.split("\n\n"))):
        if len(cur) + len(p) + 2 > most:
            if cur:
                out.append(cur)
                cur = cur[-overlap:] + "\n\n" + p if overlap else p
            else:
                own = sentences(p, most)
                out += own[:-1]
                cur = own[-1] if own else ""
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return [*out, cur] if cur else out


def simple(text, most, least):
    out, cur = [], ""
    for p in filter(None, (p.strip() for p in text.split("\n\n"))):
        if len(cur) + len(p) + 2 > most:
            out += [cur.strip()] if cur else []
            cur = p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return [*out, cur.strip()] if len(cur.strip()) >= least else out


PARTS = st.lists(st.sampled_from(["# Head", "## Two", "####", "###  x ", "#no", "\n", "\n\n", " ", "word", "Long sentence here. ", "Another! ", "| a | b |", "![x](y)", "*Страница 12*", "*Страница  3*", "\xa0", "."]), max_size=30).map("".join)
DOCS = st.lists(PARTS, min_size=1, max_size=12)


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, markdown string")


@options
@given(DOCS)
def test_sections(spark, texts):
    got = [(r.doc_id, r.section_no, r.title, r.body, r.page, r.type) for r in chunking.sections(rows(spark, texts)).orderBy("doc_id", "section_no").collect()]
    want = []
    for i, t in enumerate(texts):
        for k, (title, body) in enumerate(sections(t)):
            page = re.search(r"\*Страница\s+(\d+)\*", body)
            kind = "table" if re.search(r"\|.*\|.*\|", body) else "image_caption" if re.search(r"!\[.*\]\(.*\)", body) else "text"
            want.append((i, k, title, body, int(page[1]) if page else None, kind))
    assert got == want


@options
@given(DOCS, st.integers(5, 60), st.integers(0, 12))
def test_sub_chunks(spark, texts, most, overlap):
    got = [r.x for r in rows(spark, texts).select("doc_id", chunking.sub_chunks(F.col("markdown"), most, overlap).alias("x")).orderBy("doc_id").collect()]
    assert got == [sub_chunks(t, most, overlap) for t in texts]


@options
@given(DOCS, st.integers(5, 60), st.integers(0, 20))
def test_simple(spark, texts, most, least):
    got = [(r.doc_id, r.chunk_no, r.text) for r in chunking.chunk_simple(rows(spark, texts), most, least, "markdown").orderBy("doc_id", "chunk_no").collect()]
    assert got == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(simple(t, most, least))]


def test_edges_of_sizes(spark):
    for n in (999, 1000, 1001):
        t = "x" * (n - 500) + "\n\n" + "y" * 498
        assert [r.x for r in rows(spark, [t]).select(chunking.sub_chunks(F.col("markdown"), 1000, 100).alias("x")).collect()] == [sub_chunks(t, 1000, 100)]
    docs = rows(spark, ["# a\n" + "z" * 49, "# a\n" + "z" * 50, None, ""])
    assert [(r.doc_id, r.section) for r in chunking.chunk_markdown(docs).collect()] == [(1, "a")]
    ids = chunking.chunk_markdown(docs).select("chunk_id").collect()
    assert ids == chunking.chunk_markdown(docs).select("chunk_id").collect() and len(ids[0].chunk_id) == 8


def test_image_chunks(spark):
    charts = spark.createDataFrame([(3, "Гистограмма", "d" * 40, "t" * 301), (4, "Гистограмма", "", "")], "page_num int, chart_subtype_ru string, gpt_description string, ocr_text string")
    got = chunking.image_chunks(charts, "doc").collect()
    assert [(r.type, r.page, r.section, r.source) for r in got] == [("image_caption", 3, "Изображения и графики", "doc")]
    assert got[0].text == "[Тип: Гистограмма] [Стр. 3]\nОписание: " + "d" * 40 + "\nТекст на изображении: " + "t" * 300 + "..."


def test_stats_and_histogram(spark):
    chunks = spark.createDataFrame([("x" * n,) for n in (10, 20, 30, 110)], "text string")
    assert tuple(chunking.stats(chunks).first()) == (4, 10, 110, 42.5)
    assert sorted(map(tuple, chunking.histogram(chunks, 10).collect())) == [(0, 1), (1, 1), (2, 1), (9, 1)]
    assert chunking.histogram(chunks.filter("false")).count() == 0
