"""The operators as SQL functions of a session: `register(spark)`, then plain SQL text.

`block_type`, `section_type`, `page_mark` and `faithfulness` give a value; `line_blocks`, `markdown_sections` and
`sub_chunks` an array, which is selected and then made rows of by `LATERAL VIEW`. They are SQL themselves, so Catalyst
inlines them: columns are pruned, filters reach the scan, and no Python runs. Their rules are those of the Column forms in
`operators`: null is the empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from docspark.functions.metrics import STOP_WORDS
from docspark.functions.text import DIGIT, SPACE, SPACE_CHARS, WORD
from docspark.operators.chunking import HEADING, NO_TITLE
from docspark.operators.layout import BULLETS


def _text(value: str) -> str:
    """A string literal of SQL."""
    for raw, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        value = value.replace(raw, escaped)
    return f"'{value}'"


def _strip(c: str) -> str:
    return f"btrim({c}, {_text(SPACE_CHARS)})"


def _let(name: str, value: str, body: str) -> str:
    """body, in which name stands for value, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _kind(t: str) -> str:
    return f"""CASE WHEN length({t}) < 3 THEN 'no_text'
      WHEN length({t}) < 80 AND {t} RLIKE {_text(r"\p{IsUppercase}")} AND NOT {t} RLIKE {_text(r"[\p{IsLowercase}\p{Lt}]")} THEN 'header'
      WHEN length({t}) < 60 AND endswith({t}, ':') THEN 'header'
      WHEN {t} RLIKE {_text(f"^[{BULLETS}]")} OR {t} RLIKE {_text(f"^{DIGIT}[.)]")} THEN 'list'
      WHEN regexp_count({t}, {_text(DIGIT)}) >= 4 AND regexp_count({t}, ' ') >= 5 THEN 'table'
      ELSE 'text' END"""


def _state(out: str, cur: str) -> str:
    return f"named_struct('out', {out}, 'cur', {cur})"


def _fold(items: str, s: str, x: str, gap: str, cases: Callable[[str], list[tuple[str, str]]]) -> str:
    """Items packed into strings: the first case (condition, state) that holds, or the item after what is being packed."""
    flushed = f"CASE WHEN {s}.cur = '' THEN {s}.out ELSE array_append({s}.out, {s}.cur) END"
    grown = _state(f"{s}.out", f"CASE WHEN {s}.cur = '' THEN {x} ELSE concat({s}.cur, {_text(gap)}, {x}) END")
    steps = " ".join(f"WHEN {condition} THEN {state}" for condition, state in cases(flushed))
    start = _state("cast(array() AS array<string>)", "''")
    return f"aggregate({items}, {start}, ({s}, {x}) -> CASE {steps} ELSE {grown} END, {s} -> {flushed})"


def _sentences(p: str) -> str:
    parts = f"split({p}, {_text(f'(?<=[.!?]){SPACE}+')})"
    return _fold(parts, "u", "y", " ", lambda flushed: [("length(u.cur) + length(y) + 1 > most", _state(flushed, "y"))])


def _sub_chunks() -> str:
    paragraphs = f"filter(transform(split(body, {_text(chr(10) * 2)}), q -> {_strip('q')}), q -> q <> '')"
    over = "length(s.cur) + length(p) + 2 > most"
    carried = f"CASE WHEN overlap > 0 THEN concat(right(s.cur, overlap), {_text(chr(10) * 2)}, p) ELSE p END"
    parted = _let("v", _sentences("p"), _state("concat(s.out, slice(v, 1, size(v) - 1))", "element_at(v, -1)"))
    packed = _fold(paragraphs, "s", "p", "\n\n", lambda _: [(f"{over} AND s.cur <> ''", _state("array_append(s.out, s.cur)", carried)), (over, parted)])
    return f"CASE WHEN length(body) <= most THEN array(body) ELSE {packed} END"


def _sections() -> str:
    title = f"CASE WHEN a < 0 THEN {_text(NO_TITLE)} ELSE {_strip(f'regexp_extract(get(lines, a), {_text(HEADING)}, 2)')} END"
    found = f"transform(concat(array(-1), heads), (a, k) -> named_struct('title', {title}, 'lines', slice(lines, a + 2, coalesce(get(heads, k), size(lines)) - a - 1)))"
    full = f"transform(filter({found}, s -> size(s.lines) > 0), s -> named_struct('title', s.title, 'body', array_join(s.lines, {_text(chr(10))})))"
    heads = f"filter(transform(lines, (line, i) -> CASE WHEN line RLIKE {_text(HEADING)} THEN i END), i -> i IS NOT NULL)"
    return _let("lines", f"split(coalesce(markdown, ''), {_text(chr(10))})", _let("heads", heads, full))


def _faithfulness() -> str:
    words = lambda c: f"array_distinct(regexp_extract_all(lower(coalesce({c}, '')), {_text(WORD)}, 0))"
    content = f"array_except(said, array({', '.join(map(_text, STOP_WORDS))}))"
    share = f"round(size(array_intersect(content, {words('context')})) / size(content), 4)"
    return _let("said", words("answer"), _let("content", content, f"CASE WHEN size(said) = 0 THEN 0.0D WHEN size(content) = 0 THEN 1.0D ELSE {share} END"))


def definitions() -> dict[str, str]:
    """What follows CREATE FUNCTION, by name."""
    blocks = f"transform(split(coalesce(whole, ''), {_text(chr(10))}), (x, i) -> named_struct('block_no', i, 'page_num', cast(floor(i / per_page) + 1 AS int), 'block_type', {_let('t', _strip('x'), _kind('t'))}, 'text', x))"
    table, image = (_text(x) for x in (r"(?d)\|.*\|.*\|", r"(?d)!\[.*\]\(.*\)"))
    return {
        "block_type": f"(txt STRING) RETURNS STRING RETURN {_let('t', _strip(_text_of('txt')), _kind('t'))}",
        "section_type": f"(body STRING) RETURNS STRING RETURN CASE WHEN body RLIKE {table} THEN 'table' WHEN body RLIKE {image} THEN 'image_caption' ELSE 'text' END",
        "page_mark": f"(body STRING) RETURNS INT RETURN try_cast(nullif(regexp_extract(body, {_text(rf'\*Страница{SPACE}+(\d+)\*')}, 1), '') AS INT)",
        "faithfulness": f"(answer STRING, context STRING) RETURNS DOUBLE RETURN {_faithfulness()}",
        "line_blocks": f"(whole STRING, per_page INT) RETURNS ARRAY<STRUCT<block_no INT, page_num INT, block_type STRING, text STRING>> RETURN {blocks}",
        "markdown_sections": f"(markdown STRING) RETURNS ARRAY<STRUCT<title STRING, body STRING>> RETURN {_sections()}",
        "sub_chunks": f"(body STRING, most INT, overlap INT) RETURNS ARRAY<STRING> RETURN {_sub_chunks()}",
    }


def _text_of(c: str) -> str:
    return f"coalesce({c}, '')"


def register(spark: SparkSession) -> SparkSession:
    """Makes the functions known to the session; once more does no harm."""
    for name, rest in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
    return spark


BLOCKS = """
SELECT doc_id, b.block_no, b.page_num, b.block_type
FROM (SELECT doc_id, line_blocks(text, 20) AS blocks FROM {documents}) LATERAL VIEW explode(blocks) AS b
"""
CHUNKS = """
WITH sections AS (
  SELECT doc_id, section_no, s.title, s.body
  FROM (SELECT doc_id, markdown_sections(markdown) AS found FROM {markdowns}) LATERAL VIEW posexplode(found) AS section_no, s
), pieces AS (
  SELECT doc_id, section_no, chunk_no, title AS section, page, type, btrim(raw, {spaces}) AS text
  FROM (SELECT *, page_mark(body) AS page, section_type(body) AS type, sub_chunks(body, 1000, 100) AS parts FROM sections)
  LATERAL VIEW posexplode(parts) AS chunk_no, raw
)
SELECT doc_id, section_no, chunk_no, section, page, type, text FROM pieces WHERE length(text) >= 50
"""
FAITHFULNESS = "SELECT conv_id, turn, faithfulness(answer, context_used) AS faithfulness FROM {exchanges}"
