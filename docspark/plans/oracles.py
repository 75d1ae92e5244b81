"""The same results in SQL, written from the rules and not from the plans."""

from __future__ import annotations

from docspark.functions.metrics import STOP_WORDS
from docspark.functions.text import DIGIT, SPACE, SPACE_CHARS
from docspark.operators.charts import SUBTYPES
from docspark.plans.benchmark import SAMPLE

S = f"'{SPACE_CHARS}'"
NL = "chr(10)"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


LABELS = _list(SUBTYPES.values())
KINDS = _list(SUBTYPES)


def kind(t: str) -> str:
    """The block type of a stripped text."""
    return rf"""CASE WHEN length({t}) < 3 THEN 'no_text'
      WHEN length({t}) < 80 AND regexp_matches({t}, '\p{{Lu}}') AND NOT regexp_matches({t}, '[\p{{Ll}}\p{{Lt}}]') THEN 'header'
      WHEN length({t}) < 60 AND right({t}, 1) = ':' THEN 'header'
      WHEN left({t}, 1) IN ('•', '-', '–', '—', '▪', '►', '●') THEN 'list'
      WHEN regexp_matches({t}, '^{DIGIT}[.)]') THEN 'list'
      WHEN length({t}) - length(regexp_replace({t}, '{DIGIT}', '', 'g')) >= 4 AND length({t}) - length(replace({t}, ' ', '')) >= 5 THEN 'table'
      ELSE 'text' END"""


BLOCKS = f"""lines AS (
  SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), {NL}) AS l FROM documents)
), blocks AS (
  SELECT doc_id, CAST(i AS INTEGER) AS block_no, CAST(i // 20 + 1 AS INTEGER) AS page_num, l[i + 1] AS text, trim(l[i + 1], {S}) AS t, {kind(f"trim(l[i + 1], {S})")} AS block_type FROM lines
)"""


def item(t: str) -> str:
    bare = f"trim(regexp_replace({t}, '^[•–—▪►●-]', ''), {S})"
    return f"CASE WHEN length({bare}) > 2 AND regexp_matches({bare}, '^{DIGIT}[.)]') THEN trim(substr({bare}, 3), {S}) ELSE {bare} END"


def cells(row: str) -> str:
    parts = f"CASE WHEN contains({row}, chr(9)) THEN string_split({row}, chr(9)) ELSE regexp_split_to_array(trim({row}, {S}), '{SPACE}{{2,}}') END"
    return f"list_filter(list_transform({parts}, lambda c: trim(c, {S})), lambda c: c <> '')"


def row_line(c: str) -> str:
    return f"('| ' || coalesce(array_to_string({c}, ' | '), '') || ' |')"


MARKDOWN = BLOCKS + f""", heads AS (
  SELECT *, {cells("t")} AS c, lag(page_num) OVER (PARTITION BY doc_id ORDER BY block_no) AS before FROM blocks
), parts AS (
  SELECT doc_id, block_no,
    CASE WHEN before IS NOT DISTINCT FROM page_num THEN '' ELSE {NL} || '---' || {NL} || '*Страница ' || page_num || '*' || {NL} || {NL} END AS mark,
    CASE block_type WHEN 'no_text' THEN '' WHEN 'header' THEN '## ' || t || {NL} || {NL} WHEN 'list' THEN '- ' || {item("t")} || {NL}
      WHEN 'table' THEN {NL} || {row_line("c")} || {NL} || {row_line("list_transform(c, lambda x: '---')")} || {NL} || {NL} ELSE t || {NL} || {NL} END AS body
  FROM heads
), markdowns AS (
  SELECT doc_id, CAST('# ' || doc_id || {NL} || {NL} || left(all_of, length(all_of) - 1) AS VARCHAR) AS markdown
  FROM (SELECT doc_id, string_agg(mark || body, '' ORDER BY block_no) AS all_of FROM parts GROUP BY doc_id)
)"""

HEADING = rf"^(#{{1,3}}){SPACE}+([^\n]+)$"
SECTIONS = MARKDOWN + f""", mlines AS (
  SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(markdown, {NL}) AS l FROM markdowns)
), mrows AS (
  SELECT doc_id, i, l[i + 1] AS line, regexp_matches(l[i + 1], '{HEADING}') AS head FROM mlines
), mgroups AS (
  SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mrows
), found AS (
  SELECT doc_id, g, coalesce(max(CASE WHEN head THEN trim(regexp_extract(line, '{HEADING}', 2), {S}) END), 'Без заголовка') AS title,
    string_agg(line, {NL} ORDER BY i) FILTER (NOT head) AS body FROM mgroups GROUP BY doc_id, g HAVING count(*) FILTER (NOT head) > 0
), sections AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS section_no, title, body,
    TRY_CAST(nullif(regexp_extract(body, '\\*Страница{SPACE}+([0-9]+)\\*', 1), '') AS INTEGER) AS page,
    CASE WHEN regexp_matches(body, '\\|[^\\n]*\\|[^\\n]*\\|') THEN 'table' WHEN regexp_matches(body, '!\\[[^\\n]*\\]\\([^\\n]*\\)') THEN 'image_caption' ELSE 'text' END AS type FROM found
)""".replace("\\\\", "\\")

# The folds are recursions over numbered items: sentences of paragraphs first, then paragraphs of sections.
CHUNKS = SECTIONS.replace("lines AS (", "RECURSIVE_MARK lines AS (", 1) + f""", paras AS (
  SELECT doc_id, section_no, p, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY k) AS k FROM (
    SELECT doc_id, section_no, trim(l[k + 1], {S}) AS p, k FROM (SELECT doc_id, section_no, l, unnest(range(len(l))) AS k FROM (
      SELECT doc_id, section_no, string_split(body, {NL} || {NL}) AS l FROM sections WHERE length(body) > 1000))) WHERE p <> ''
), sents AS (
  SELECT doc_id, section_no, k, s[j + 1] AS s, j + 1 AS j, len(s) AS n FROM (SELECT doc_id, section_no, k, s, unnest(range(len(s))) AS j FROM (
    SELECT doc_id, section_no, k, string_split(regexp_replace(p, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM paras WHERE length(p) + 2 > 1000))
), packed AS (
  SELECT doc_id, section_no, k, j, n, CAST([] AS VARCHAR[]) AS out, s AS cur FROM sents WHERE j = 1
  UNION ALL
  SELECT x.doc_id, x.section_no, x.k, x.j, x.n,
    CASE WHEN length(r.cur) + length(x.s) + 1 > 1000 AND r.cur <> '' THEN list_append(r.out, r.cur) ELSE r.out END,
    CASE WHEN length(r.cur) + length(x.s) + 1 > 1000 OR r.cur = '' THEN x.s ELSE r.cur || ' ' || x.s END
  FROM packed r JOIN sents x ON x.doc_id = r.doc_id AND x.section_no = r.section_no AND x.k = r.k AND x.j = r.j + 1
), splits AS (
  SELECT doc_id, section_no, k, out, cur FROM packed WHERE j = n
), steps AS (
  SELECT p.*, s.out AS s_out, s.cur AS s_cur FROM paras p LEFT JOIN splits s USING (doc_id, section_no, k)
), folded AS (
  SELECT doc_id, section_no, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS out, '' AS cur FROM (SELECT DISTINCT doc_id, section_no FROM paras)
  UNION ALL
  SELECT x.doc_id, x.section_no, x.k,
    CASE WHEN length(r.cur) + length(x.p) + 2 > 1000 THEN CASE WHEN r.cur <> '' THEN list_append(r.out, r.cur) ELSE list_concat(r.out, x.s_out) END ELSE r.out END,
    CASE WHEN length(r.cur) + length(x.p) + 2 > 1000 THEN CASE WHEN r.cur <> '' THEN right(r.cur, 100) || {NL} || {NL} || x.p ELSE x.s_cur END
         WHEN r.cur = '' THEN x.p ELSE r.cur || {NL} || {NL} || x.p END
  FROM folded r JOIN steps x ON x.doc_id = r.doc_id AND x.section_no = r.section_no AND x.k = r.k + 1
), ended AS (
  SELECT doc_id, section_no, CASE WHEN cur = '' THEN out ELSE list_append(out, cur) END AS l FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY k DESC) AS rn FROM folded) WHERE rn = 1
  UNION ALL
  SELECT doc_id, section_no, [body] FROM sections WHERE length(body) <= 1000
), pieces AS (
  SELECT doc_id, section_no, CAST(i AS INTEGER) AS chunk_no, trim(l[i + 1], {S}) AS text FROM (SELECT *, unnest(range(len(l))) AS i FROM ended)
)""".replace("\\\\1", "\\1")

SIMPLE = f"""paras AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k FROM (
    SELECT doc_id, trim(l[k + 1], {S}) AS p, k FROM (SELECT doc_id, l, unnest(range(len(l))) AS k FROM (
      SELECT doc_id, string_split(replace(coalesce(text, ''), {NL}, {NL} || {NL}), {NL} || {NL}) AS l FROM documents))) WHERE p <> ''
), folded AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS out, '' AS cur FROM (SELECT DISTINCT doc_id FROM paras)
  UNION ALL
  SELECT x.doc_id, x.k, CASE WHEN length(r.cur) + length(x.p) + 2 > 1000 AND r.cur <> '' THEN list_append(r.out, r.cur) ELSE r.out END,
    CASE WHEN length(r.cur) + length(x.p) + 2 > 1000 OR r.cur = '' THEN x.p ELSE r.cur || {NL} || {NL} || x.p END
  FROM folded r JOIN paras x ON x.doc_id = r.doc_id AND x.k = r.k + 1
), ended AS (
  SELECT doc_id, CASE WHEN length(trim(cur, {S})) >= 50 THEN list_append(out, cur) ELSE out END AS l FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS rn FROM folded) WHERE rn = 1
), simple AS (
  SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, trim(l[i + 1], {S}) AS text FROM (SELECT *, unnest(range(len(l))) AS i FROM ended)
)"""

ANALYSES = f"""analyses AS (
  SELECT doc_id, CAST(doc_id % 40 + 1 AS INTEGER) AS page_num, ({LABELS})[doc_id % 9 + 1] AS label,
    coalesce(text, '') AS said, coalesce(text, '') AS ocr,
    CASE WHEN doc_id % 5 > 0 THEN 'img' || doc_id || '.png' END AS path FROM documents
)"""


def preview(c: str, n: int) -> str:
    return f"(CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END)"


PICTURES = """pictures AS (
  SELECT source AS doc_id, CAST(doc_id % 10 AS INTEGER) AS page_num, doc_id AS idx, md5(coalesce(text, '')) AS image_hash, CAST(n_chars % 300 AS INTEGER) AS width, CAST(n_chars % 170 AS INTEGER) AS height FROM documents
)"""
KEPT = PICTURES + """, firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, image_hash ORDER BY page_num, idx) AS rn FROM pictures WHERE width >= 50 AND height >= 50 AND width * height >= 5000) WHERE rn = 1
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, idx) AS image_no FROM firsts
)"""

PROBS = """l AS (SELECT vec_id, list_transform(embedding[1:%d], lambda x: CAST(x AS DOUBLE) * 10) AS v FROM embeddings),
e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS v FROM l),
p AS (SELECT vec_id, list_transform(v, lambda x: x / list_sum(v)) AS p FROM e)"""
TWO = PROBS % 6 + """, s AS (SELECT vec_id, list_sum(p[1:3]) / 3 AS c, list_sum(p[4:6]) / 3 AS i FROM p), k AS (
  SELECT vec_id, CASE WHEN c > i THEN 'chart' ELSE 'image' END AS block_type, round(greatest(c, i) / (c + i), 4) AS confidence, round(c, 4) AS chart_score, round(i, 4) AS image_score FROM s)"""

COLOR = """CASE WHEN r > 200 AND g < 80 AND b < 80 THEN 'красный' WHEN r < 80 AND g > 200 AND b < 80 THEN 'зелёный' WHEN r < 80 AND g < 80 AND b > 200 THEN 'синий'
  WHEN r > 200 AND g > 200 AND b < 80 THEN 'жёлтый' WHEN r > 200 AND g > 100 AND b < 80 THEN 'оранжевый' WHEN r > 150 AND g < 80 AND b > 150 THEN 'фиолетовый'
  WHEN r < 80 AND g > 150 AND b > 150 THEN 'бирюзовый' WHEN r > 80 AND r < 180 AND g > 80 AND g < 180 AND b > 80 AND b < 180 THEN 'серый'
  WHEN r > 200 AND g > 150 AND b > 150 THEN 'розовый' WHEN r < 100 AND g < 100 AND b < 100 THEN 'тёмный' ELSE 'цветной' END"""
COLOURS = "colours AS (SELECT vec_id, label AS image_no, CAST(vec_id * 37 % 256 AS INTEGER) AS r, CAST(vec_id * 59 % 256 AS INTEGER) AS g, CAST(vec_id * 83 % 256 AS INTEGER) AS b FROM embeddings)"

VECS = """raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
units AS (SELECT vec_id AS row_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v,
  CASE WHEN vec_id % 4 = 0 THEN 'image_caption' ELSE 'text' END AS type, CAST(vec_id % 5 AS INTEGER) AS page, CASE WHEN label = 0 THEN '' ELSE 'S' || label END AS section FROM raw)"""
ONE = VECS + ", scored AS (SELECT u.row_id, u.type, list_inner_product(u.v, q.v) AS score FROM units u, (SELECT v FROM units WHERE row_id = 7) q)"
BATCH = VECS + """, best AS (
  SELECT * FROM (SELECT q.row_id AS query_id, u.row_id, list_inner_product(u.v, q.v) AS score, u.type, u.page, u.section,
    CAST(row_number() OVER (PARTITION BY q.row_id ORDER BY list_inner_product(u.v, q.v) DESC, u.row_id) AS INTEGER) AS rank
    FROM units u, units q WHERE q.row_id % 50 = 0) WHERE rank <= 5
), hits AS (
  SELECT b.*, d.text, substr(sha256(CAST(b.row_id AS VARCHAR)), 1, 8) AS chunk_id FROM best b JOIN documents d ON d.doc_id = b.row_id
)"""
GAP = f"{NL} || {NL} || '---' || {NL} || {NL}"


def contexts(head: str) -> str:
    return BATCH + f""", contexts AS (
  SELECT q.vec_id AS query_id, coalesce(c.context, 'Контекст не найден.') AS context FROM embeddings q LEFT JOIN (
    SELECT query_id, string_agg({head} || ':' || {NL} || text, {GAP} ORDER BY rank) AS context FROM hits GROUP BY query_id) c ON c.query_id = q.vec_id WHERE q.vec_id % 50 = 0
)"""


WHERE = "'стр. ' || page || CASE WHEN section <> '' THEN ', раздел: ' || section ELSE '' END"
LABELLED = contexts(f"'[Фрагмент ' || rank || '] (' || CASE WHEN type = 'image_caption' THEN 'описание графика/изображения' ELSE 'текст' END || CASE WHEN page <> 0 THEN ', ' || {WHERE} ELSE '' END || ')'")
PLAIN = contexts(f"'[Фрагмент ' || rank || ']' || CASE WHEN page <> 0 THEN ' (' || {WHERE} || ')' ELSE '' END")

PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, coalesce(u.text, '') AS reference, coalesce(a.text, '') AS answer, substr(coalesce(u.text, ''), 1, 200) || '...' AS context_used
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'
)"""
WORDS = lambda t: rf"list_distinct(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+'))"
FAITH = PAIRS + f""", sets AS (
  SELECT conv_id, turn, {WORDS("answer")} AS a, list_filter({WORDS("answer")}, lambda w: NOT list_contains({_list(STOP_WORDS)}, w)) AS c, {WORDS("context_used")} AS x FROM pairs
), faith AS (
  SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0.0 WHEN len(c) = 0 THEN 1.0 ELSE round(CAST(len(list_filter(c, lambda w: list_contains(x, w))) AS DOUBLE) / len(c), 4) END AS faithfulness FROM sets
)"""
TOKENS = lambda t: rf"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"
BLEU = PAIRS + f""", toks AS (
  SELECT conv_id, turn, {TOKENS("reference")} AS r, {TOKENS("answer")} AS h FROM pairs
), grams AS (
  SELECT conv_id, turn, 'r' AS side, 1 AS n, unnest(r) AS g FROM toks UNION ALL SELECT conv_id, turn, 'h', 1, unnest(h) FROM toks
  UNION ALL SELECT conv_id, turn, 'r', 2, unnest(list_transform(range(1, len(r)), lambda i: r[i] || chr(1) || r[i + 1])) FROM toks
  UNION ALL SELECT conv_id, turn, 'h', 2, unnest(list_transform(range(1, len(h)), lambda i: h[i] || chr(1) || h[i + 1])) FROM toks
), counted AS (
  SELECT conv_id, turn, n, g, count(*) FILTER (side = 'r') AS cr, count(*) FILTER (side = 'h') AS ch FROM grams GROUP BY ALL
), clipped AS (
  SELECT conv_id, turn, coalesce(sum(least(cr, ch)) FILTER (n = 1), 0) AS c1, coalesce(sum(least(cr, ch)) FILTER (n = 2), 0) AS c2 FROM counted GROUP BY conv_id, turn
), bleus AS (
  SELECT conv_id, turn, CASE WHEN len(r) = 0 OR len(h) = 0 OR c1 = 0 THEN 0.0 ELSE round(CASE WHEN len(h) > len(r) THEN 1.0 ELSE exp(1 - CAST(len(r) AS DOUBLE) / len(h)) END
    * exp(0.5 * ln(CAST(c1 AS DOUBLE) / len(h)) + 0.5 * ln(CASE WHEN c2 = 0 THEN 0.1 ELSE CAST(c2 AS DOUBLE) END / greatest(1, len(h) - 1))), 4) END AS bleu FROM toks LEFT JOIN clipped USING (conv_id, turn)
)"""

ROUGE = PAIRS + rf""", seqs AS (
  SELECT conv_id, turn, regexp_extract_all(lower(reference), '[\p{{L}}\p{{N}}_]+') AS r, regexp_extract_all(lower(answer), '[\p{{L}}\p{{N}}_]+') AS h FROM pairs
), common AS (
  SELECT conv_id, turn, r, h, 0 AS j, list_transform(r, lambda x: 0) AS best FROM seqs
  UNION ALL
  SELECT conv_id, turn, r, h, j + 1, list_transform(range(1, len(r) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda k:
    greatest(best[k], CASE WHEN r[k] = h[j + 1] THEN coalesce(best[k - 1], 0) + 1 ELSE 0 END)))) FROM common WHERE j < len(h)
), rouges AS (
  SELECT conv_id, turn, CASE WHEN len(r) = 0 OR len(h) = 0 OR best[len(r)] = 0 THEN 0.0 ELSE
    round(2 * (CAST(best[len(r)] AS DOUBLE) / len(h)) * (CAST(best[len(r)] AS DOUBLE) / len(r)) / (CAST(best[len(r)] AS DOUBLE) / len(h) + CAST(best[len(r)] AS DOUBLE) / len(r)), 4) END AS rouge_l FROM common WHERE j = len(h)
)"""

METRICS = ", ".join([ROUGE, FAITH.removeprefix(PAIRS + ", "), BLEU.removeprefix(PAIRS + ", ")])
# The sample questions in place of conversations.
SAMPLES = "pairs AS (SELECT i AS conv_id, 0 AS turn, question, reference, category, question || ' ' || reference AS answer, reference AS context_used FROM (VALUES " + ", ".join(
    f"({i}, " + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for i, row in enumerate(SAMPLE)
) + ") t(i, question, reference, category))"

# Vectors of hashed words as sparse rows: whole numbers, so that sums are exact.
HASHED = lambda source, key, text: f"""SELECT {key} AS id, CAST(('0x' || substr(m, 1, 8)) AS BIGINT) % 384 AS b, sum(CASE WHEN substr(m, 9, 1) < '8' THEN 1 ELSE -1 END) AS v
  FROM (SELECT {key}, md5(unnest(list_filter(regexp_split_to_array(lower({text}), '{SPACE}+'), lambda x: x <> ''))) AS m FROM {source}) GROUP BY 1, 2"""  # noqa: E731

KEYWORDS = """found AS (
  SELECT conv_id, turn, text, w, unnest(range(len(w))) AS i FROM (SELECT conv_id, turn, text, regexp_extract_all(coalesce(text, ''), '[а-яА-ЯёЁa-zA-Z]{3,}') AS w FROM conversations)
), uniq AS (
  SELECT conv_id, turn, min(i) AS i, min_by(w[i + 1], i) AS word FROM found GROUP BY conv_id, turn, lower(w[i + 1])
), keyed AS (
  SELECT c.conv_id, c.turn, coalesce(k.words, CAST([] AS VARCHAR[])) AS words FROM conversations c LEFT JOIN (SELECT conv_id, turn, list(word ORDER BY i) AS words FROM uniq GROUP BY conv_id, turn) k USING (conv_id, turn)
)"""

MARKS = "['• ', '- ', '1. ', '2) ', '– ', '0.52 ', '', '► ']"
ITEMS = f"""items AS (
  SELECT page_id, CAST(i AS INTEGER) AS item_no, ({MARKS})[i % 8 + 1] || w[i + 1] AS text FROM (
    SELECT page_id, w, unnest(range(len(w))) AS i FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<li><a [^>]*>([^<]*)</a></li>', 1) AS w FROM pages))
)"""

TABLE_TEXT = f"string_split(trim(replace(replace(text, ', ', '  '), '. ', {NL}), {S}), {NL})"
TABLES = BLOCKS + f""", split AS (SELECT doc_id, block_no, {TABLE_TEXT} AS rows FROM blocks), tables AS (
  SELECT doc_id, block_no, rows, {cells("rows[1]")} AS h FROM split
)"""


def oracle_sql() -> dict[str, str]:
    row_of = row_line("list_concat(x, list_transform(range(len(h)), lambda i: ''))[1:len(h)]")
    joined = lambda *parts: f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), {NL})"
    chart = joined(
        "'### [График: ' || label || ']'", "''", "CASE WHEN path IS NOT NULL THEN '![' || label || ', стр. ' || page_num || '](' || path || ')' || chr(10) END",
        "CASE WHEN said <> '' THEN '**Транскрипция:** ' || said || chr(10) END", f"CASE WHEN ocr <> '' THEN '*OCR-текст:* ' || {preview('ocr', 200)} || chr(10) END",
    )
    image = joined(
        "CASE WHEN p <> '' THEN '![Изображение со стр. ' || page_num || '](' || p || ')' ELSE '*[Изображение со стр. ' || page_num || ']*' END",
        f"CASE WHEN ocr <> '' THEN '*Текст на изображении:* ' || {preview('ocr', 100)} END", "''",
    )
    chart_chunk = joined("'[Тип: ' || label || '] [Стр. ' || page_num || ']'", "CASE WHEN said <> '' THEN 'Описание: ' || said END", f"CASE WHEN ocr <> '' THEN 'Текст на изображении: ' || {preview('ocr', 300)} END")
    union = f"""{SIMPLE}, {ANALYSES}, every AS (
      SELECT 0 AS branch, text, 'text' AS type, CAST(NULL AS INTEGER) AS page, CAST(NULL AS VARCHAR) AS section FROM simple
      UNION ALL SELECT 1, t, 'image_caption', page_num, 'Изображения и графики' FROM (SELECT {chart_chunk} AS t, page_num FROM analyses) WHERE length(trim(t, {S})) >= 50)"""
    chunks = CHUNKS.replace("RECURSIVE_MARK ", "")
    place = "CAST(('0x' || substr(md5(p.doc_id || '/' || p.section_no || '/' || p.chunk_no), 1, 15)) AS BIGINT)"
    part = f"'[Фрагмент ' || rank || '] (' || CASE WHEN type = 'image_caption' THEN 'описание графика/изображения' ELSE 'текст' END || CASE WHEN coalesce(page, 0) <> 0 THEN ', ' || {WHERE} ELSE '' END || '):' || {NL} || text"
    answered = f"""WITH RECURSIVE {chunks}, made AS (
        SELECT {place} AS row_id, p.text, s.page, coalesce(s.title, '') AS section, s.type FROM pieces p JOIN sections s USING (doc_id, section_no) WHERE length(p.text) >= 50
      ), own AS ({HASHED("made", "row_id", "text")}), given AS ({HASHED("benchmark", "item_id", "text")}),
      sizes AS (SELECT id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS n FROM own GROUP BY id), lengths AS (SELECT id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS n FROM given GROUP BY id),
      dots AS (SELECT g.id AS query_id, o.id AS row_id, CAST(sum(g.v * o.v) AS DOUBLE) AS d FROM given g JOIN own o USING (b) GROUP BY 1, 2),
      pairs AS (SELECT b.item_id AS query_id, m.row_id, round(coalesce(d / n.n / l.n, 0), 12) AS score FROM benchmark b CROSS JOIN made m LEFT JOIN dots ON query_id = b.item_id AND dots.row_id = m.row_id LEFT JOIN sizes n ON n.id = m.row_id LEFT JOIN lengths l ON l.id = b.item_id),
      top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM pairs) WHERE rank <= 5),
      told AS (SELECT query_id, string_agg({part}, {GAP} ORDER BY rank) AS context FROM top JOIN made USING (row_id) GROUP BY query_id)
      SELECT query_id, b.text AS question, '[LLM API недоступен — показываю найденный контекст]' || {NL} || {NL} || 'Вопрос: ' || b.text || {NL} || {NL} || 'Найденные фрагменты:' || {NL} || context AS answer,
        'stub' AS model, substr(context, 1, 200) || '...' AS context_used FROM told JOIN benchmark b ON b.item_id = query_id"""
    stub = f"'[LLM API недоступен — показываю найденный контекст]' || {NL} || {NL} || 'Вопрос: Q' || query_id || {NL} || {NL} || 'Найденные фрагменты:' || {NL} || context"
    far = "(r - x.r) * (r - x.r) + (g - x.g) * (g - x.g) + (b - x.b) * (b - x.b)"
    draw = lambda step: f"-ln((CAST(CAST('0x' || substr(md5({step} || ':' || r || ':' || g || ':' || b), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0)"
    found = {
        "block_classify": f"WITH {BLOCKS} SELECT doc_id, block_no, page_num, block_type FROM blocks",
        "block_type_counts": f"WITH {BLOCKS} SELECT block_type, count(*) AS n FROM blocks GROUP BY block_type",
        "stream_type_counts": f"WITH {BLOCKS} SELECT block_type, count(*) AS n FROM blocks GROUP BY block_type",
        "first_block_per_type": f"WITH {BLOCKS} SELECT block_type, doc_id, block_no, text FROM (SELECT *, row_number() OVER (PARTITION BY block_type ORDER BY doc_id, block_no) AS rn FROM blocks WHERE text <> '') WHERE rn = 1",
        "page_parse": f"""WITH t AS (SELECT conv_id AS doc_id, turn AS block_no, turn % 3 AS k, trim(coalesce(text, ''), {S}) AS t FROM conversations)
          SELECT doc_id, block_no, CASE WHEN k = 0 THEN {kind("t")} ELSE 'no_text' END AS block_type, CASE WHEN k = 0 THEN t END AS text FROM t WHERE k = 1 OR k = 0 AND t <> ''""",
        "list_render": f"WITH {ITEMS} SELECT page_id, item_no, {kind(f'trim(text, {S})')} AS block_type, '- ' || {item(f'trim(text, {S})')} AS line FROM items",
        "table_row_split": f"""WITH {BLOCKS}, c AS (SELECT doc_id, block_no, replace(replace(text, ', ', '  '), ' the ', chr(9)) AS r FROM blocks), d AS (SELECT doc_id, block_no, {cells("r")} AS x FROM c)
          SELECT doc_id, block_no, CAST(len(x) AS INTEGER) AS n_cells, coalesce(array_to_string(x, '|'), '') AS cells FROM d""",
        "table_render": f"""WITH {TABLES} SELECT doc_id, block_no, {NL} || {row_line("h")} || {NL} || {row_line("list_transform(h, lambda x: '---')")} || {NL} ||
          coalesce(array_to_string(list_transform(list_transform(rows[2:], lambda r: {cells("r")}), lambda x: {row_of} || {NL}), ''), '') AS markdown FROM tables""",
        "markdown_build": f"WITH {MARKDOWN} SELECT doc_id, markdown FROM markdowns",
        "sections": f"WITH {SECTIONS} SELECT doc_id, section_no, title, body, page, type FROM sections",
        "chunk_sections": f"WITH {CHUNKS} SELECT doc_id, section_no, chunk_no, s.title AS section, s.page, s.type, p.text FROM pieces p JOIN sections s USING (doc_id, section_no) WHERE length(p.text) >= 50".replace("RECURSIVE_MARK ", "").replace("WITH ", "WITH RECURSIVE ", 1),
        "sections_long": f"WITH {SECTIONS} SELECT doc_id, section_no, title, page, type, CAST(length(body) AS BIGINT) AS length FROM sections",
        "chunk_simple": f"WITH RECURSIVE {SIMPLE} SELECT doc_id, chunk_no, text FROM simple",
        "chunk_stats": f"WITH RECURSIVE {SIMPLE} SELECT count(*) AS n, CAST(min(length(text)) AS INTEGER) AS least, CAST(max(length(text)) AS INTEGER) AS most, round(avg(length(text)), 4) AS mean FROM simple",
        "chunk_histogram": f"""WITH RECURSIVE {SIMPLE}, ends AS (SELECT min(length(text)) AS lo, max(length(text)) AS hi FROM simple)
          SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(19, (length(text) - lo) * 20 // (hi - lo)) END AS INTEGER) AS bin, count(*) AS n FROM simple, ends GROUP BY 1""",
        "chunk_union_images": f"WITH RECURSIVE {union} SELECT branch, text, type, page, section FROM every",
        "chart_markdown": f"WITH {ANALYSES} SELECT doc_id, {chart} AS markdown FROM analyses",
        "image_markdown": f"WITH {ANALYSES}, q AS (SELECT *, coalesce(path, CASE WHEN doc_id % 10 = 0 THEN 'other.png' END, '') AS p FROM analyses) SELECT doc_id, {image} AS markdown FROM q",
        "image_size_filter": f"WITH {PICTURES} SELECT doc_id, idx, width, height FROM pictures WHERE width >= 50 AND height >= 50 AND width * height >= 5000",
        "dedup_first": f"WITH {PICTURES} SELECT doc_id, image_hash, page_num, idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, image_hash ORDER BY page_num, idx) AS rn FROM pictures) WHERE rn = 1",
        "dedup_limit_number": f"WITH {KEPT} SELECT doc_id, idx, CAST(image_no AS INTEGER) AS image_no, doc_id || '_p' || (page_num + 1) || '_img' || image_no || '.png' AS file_name FROM kept WHERE image_no <= 20",
        "image_summary": f"""WITH {KEPT} SELECT count(*) AS total_images, count(DISTINCT page_num) AS pages_with_images, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT page_num + 1 AS p FROM kept)) AS pages,
          CAST(trunc(avg(width)) AS INTEGER) AS avg_width, CAST(trunc(avg(height)) AS INTEGER) AS avg_height, CAST(sum(CAST(width AS BIGINT) * height) AS BIGINT) AS total_pixels FROM kept""",
        "image_boxes": """WITH e AS (SELECT vec_id, vec_id % 20 AS d, vec_id % 4 AS p, label AS x FROM embeddings), f AS (SELECT d, p, x, min(vec_id) AS i FROM e WHERE x % 2 = 0 GROUP BY d, p, x)
          SELECT e.vec_id, CASE WHEN f.i IS NULL THEN 'page' || e.p ELSE 'box' || f.i END AS bbox FROM e LEFT JOIN f USING (d, p, x)""",
        "zero_shot_2class": f"WITH {TWO} SELECT vec_id, block_type, confidence, chart_score, image_score FROM k",
        "image_kind_counts": f"WITH {TWO} SELECT count(*) FILTER (block_type = 'chart') AS charts, count(*) FILTER (block_type = 'image') AS images FROM k",
        "zero_shot_argmax": f"WITH {PROBS % 9}, b AS (SELECT vec_id, list_position(p, list_max(p)) AS place, list_max(p) AS m FROM p) SELECT vec_id, ({KINDS})[place] AS chart_subtype, ({LABELS})[place] AS chart_subtype_ru, round(m, 4) AS confidence FROM b",
        "color_name": f"WITH {COLOURS} SELECT vec_id, {COLOR} AS color FROM colours",
        "dominant_share": f"""WITH {COLOURS}, c AS (SELECT image_no, r // 64 * 4 + g // 64 AS cluster, CAST(trunc(avg(r)) AS INTEGER) AS r, CAST(trunc(avg(g)) AS INTEGER) AS g, CAST(trunc(avg(b)) AS INTEGER) AS b, count(*) AS n FROM colours GROUP BY 1, 2),
          s AS (SELECT *, n / sum(n) OVER (PARTITION BY image_no) AS share FROM c), k AS (SELECT *, {COLOR} || ' (#' || printf('%02x%02x%02x', r, g, b) || ', ' || CAST(round_even(share * 100, 0) AS INTEGER) || '%)' AS t FROM s
            WHERE share >= 0.05 AND NOT (r > 230 AND g > 230 AND b > 230) AND NOT (r < 25 AND g < 25 AND b < 25))
          SELECT image_no, array_to_string((list(t ORDER BY n DESC, cluster))[1:5], '; ') AS dominant_colors, CAST(count(*) AS INTEGER) AS num_color_segments FROM k GROUP BY image_no""",
        "colour_groups": f"""WITH RECURSIVE {COLOURS}, c AS (SELECT image_no, r, g, b, count(*) AS n FROM colours WHERE image_no IS NOT NULL GROUP BY ALL),
          seeds AS (
            SELECT 1 AS step, image_no, [{{'r': CAST(won.r AS DOUBLE), 'g': CAST(won.g AS DOUBLE), 'b': CAST(won.b AS DOUBLE)}}] AS centres FROM (SELECT image_no, min({{'race': {draw("0")} / n, 'r': r, 'g': g, 'b': b}}) AS won FROM c GROUP BY image_no)
            UNION ALL SELECT step + 1, image_no, list_append(centres, {{'r': CAST(won.r AS DOUBLE), 'g': CAST(won.g AS DOUBLE), 'b': CAST(won.b AS DOUBLE)}})
            FROM (SELECT step, image_no, centres, min({{'race': {draw("step")} / (n * far), 'r': r, 'g': g, 'b': b}}) AS won
              FROM (SELECT s.*, r, g, b, n, list_min(list_transform(centres, lambda x: {far})) AS far FROM seeds s JOIN c USING (image_no) WHERE step < 5) WHERE far > 0 GROUP BY step, image_no, centres)
          ), rounds AS (
            SELECT 0 AS step, image_no, arg_max(centres, step) AS centres FROM seeds GROUP BY image_no
            UNION ALL SELECT step + 1, image_no, list_transform(centres, lambda x, i: coalesce(list_filter(means, lambda m: m.i = i)[1].c, x))
            FROM (SELECT step, image_no, centres, list({{'i': i, 'c': {{'r': r, 'g': g, 'b': b}}}}) AS means FROM (
              SELECT step, image_no, centres, i, sum(r * n) / sum(n) AS r, sum(g * n) / sum(n) AS g, sum(b * n) / sum(n) AS b
              FROM (SELECT s.*, r, g, b, n, list_transform(centres, lambda x: {far}) AS d, list_position(d, list_min(d)) AS i FROM rounds s JOIN c USING (image_no) WHERE step < 20) GROUP BY step, image_no, centres, i) GROUP BY step, image_no, centres)
          ), last AS (SELECT image_no, r, g, b, n, list_transform(centres, lambda x: {far}) AS d, list_position(d, list_min(d)) AS i FROM rounds JOIN c USING (image_no) WHERE step = 20)
          SELECT image_no, CAST(i - 1 AS INTEGER) AS cluster, CAST(trunc(sum(r * n) / sum(n)) AS INTEGER) AS r, CAST(trunc(sum(g * n) / sum(n)) AS INTEGER) AS g, CAST(trunc(sum(b * n) / sum(n)) AS INTEGER) AS b, CAST(sum(n) AS BIGINT) AS n
          FROM last GROUP BY image_no, i""",
        "ocr_lines": f"""WITH c AS (SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(replace(coalesce(text, ''), ' ', {NL}), {NL}), lambda x: trim(x, {S})), lambda x: length(x) > 2 OR regexp_matches(x, '^{DIGIT}+$')), {NL}), '') AS ocr_text FROM documents)
          SELECT doc_id, ocr_text, length(trim(ocr_text, {S})) > 10 AS has_text FROM c""",
        "ocr_boxes": f"""WITH w AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS w FROM conversations), b AS (
            SELECT conv_id, turn, list_transform(list_filter(range(len(w)), lambda i: trim(w[i + 1], {S}) <> '' AND (i * 17 + length(w[i + 1])) % 100 > 30), lambda i: trim(w[i + 1], {S})) AS k FROM w)
          SELECT conv_id, turn, CAST(len(k) AS INTEGER) AS n_boxes, coalesce(array_to_string(k, ' '), '') AS words FROM b""",
        "keyword_list": f"WITH {KEYWORDS} SELECT conv_id, turn, coalesce(array_to_string(words, ' '), '') AS keywords FROM keyed",
        "fallback_desc": f"""WITH {KEYWORDS} SELECT conv_id, turn, ({LABELS})[conv_id % 9 + 1] || CASE WHEN turn % 2 = 0 THEN '. (BLIP: a chart)' ELSE '' END ||
          CASE WHEN len(words) > 0 THEN '. Ключевые слова: ' || array_to_string(words[1:8], ', ') ELSE '' END || '.' AS description FROM keyed""",
        "vec_normalize": """WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 3)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM r),
          u AS (SELECT vec_id, list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS v FROM n) SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) + CAST(0 AS DOUBLE) AS length, round(v[1], 6) + CAST(0 AS DOUBLE) AS first, round(v[64], 6) + CAST(0 AS DOUBLE) AS last FROM u""",
        "topk_single": f"WITH {ONE} SELECT row_id, round(score, 4) AS score FROM scored ORDER BY scored.score DESC, row_id LIMIT 10",
        "topk_filtered": f"WITH {ONE} SELECT row_id, type, round(score, 4) AS score FROM (SELECT * FROM scored ORDER BY scored.score DESC, row_id LIMIT 30) x WHERE type = 'image_caption' ORDER BY x.score DESC, row_id LIMIT 10",
        "topk_filtered_batch": f"""WITH {VECS}, pairs AS (
          SELECT q.row_id AS query_id, u.row_id, u.type, list_inner_product(u.v, q.v) AS score FROM units u, units q WHERE q.row_id % 50 = 0
        ), placed AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS place FROM pairs
        ), kept AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INTEGER) AS rank FROM placed WHERE place <= 30 AND type = 'image_caption'
        ) SELECT query_id, rank, row_id, type, round(score, 4) AS score FROM kept WHERE rank <= 10""",
        "topk_pruned": f"WITH {BATCH} SELECT query_id, rank, row_id, round(score, 4) AS score FROM best",
        "topk_batch": f"WITH {BATCH} SELECT query_id, rank, row_id, round(score, 4) AS score FROM best",
        "context_join": f"WITH {LABELLED} SELECT query_id, context FROM contexts",
        "context_plain": f"WITH {PLAIN} SELECT query_id, context FROM contexts",
        "context_numbered": "WITH " + contexts("'[' || rank || ']'") + " SELECT query_id, context FROM contexts",
        "source_projection": f"WITH {BATCH} SELECT query_id, rank, chunk_id, round(score, 4) AS score, page, section, type AS chunk_type, substr(text, 1, 100) AS text_preview FROM hits",
        "stub_answer": f"WITH {LABELLED} SELECT query_id, {stub} AS answer, 'stub' AS model, substr(context, 1, 200) || '...' AS context_used, 0 AS total_tokens FROM contexts",
        "prompt_render": f"WITH {LABELLED} SELECT query_id, 'Контекст из документа:' || {NL} || context || {NL} || {NL} || '---' || {NL} || {NL} || 'Вопрос: Q' || query_id || {NL} || {NL} || 'Ответ:' AS prompt FROM contexts",
        "visual_chunk": f"WITH RECURSIVE {union} SELECT page, text FROM every WHERE contains(lower(text), 'график') OR contains(lower(text), 'диаграмм') ORDER BY page NULLS FIRST, text LIMIT 1",
        "visual_chunks": r"""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}{9,}')) AS word FROM benchmark),
          f AS (SELECT word, min(doc_id) AS doc_id FROM (SELECT DISTINCT word FROM w) JOIN documents ON contains(lower(coalesce(text, '')), word) GROUP BY word)
          SELECT item_id, min(doc_id) AS doc_id FROM w JOIN f USING (word) GROUP BY item_id""",
        "near_words": r"""WITH t AS (SELECT row_number() OVER () AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
          b AS (SELECT id, i, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 32768 AS b FROM (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t)),
          l AS (SELECT b, unnest([lead(b, 1) OVER o, lead(b, 2) OVER o, lead(b, 3) OVER o, lead(b, 4) OVER o]) AS c FROM b WINDOW o AS (PARTITION BY id ORDER BY i)),
          p AS (SELECT word, context, count(*) AS n FROM (SELECT b AS word, c AS context FROM l WHERE c IS NOT NULL UNION ALL SELECT c, b FROM l WHERE c IS NOT NULL) GROUP BY ALL),
          o AS (SELECT word, CAST(sum(n) AS DOUBLE) AS own FROM p GROUP BY word), e AS (SELECT sum(pow(own, 0.75)) AS powers FROM o),
          w AS (SELECT p.word, n, ln(n * powers / (a.own * pow(c.own, 0.75))) AS weight FROM p JOIN o a ON a.word = p.word JOIN o c ON c.word = p.context, e)
          SELECT CAST(word AS INTEGER) AS word, count(*) AS contexts, CAST(sum(n) AS BIGINT) AS n, round(sum(weight), 4) AS weight FROM w WHERE weight > 0 GROUP BY word""",
        "neighbour_graph": f"""WITH {VECS}, p AS (SELECT min(row_id) AS point, v FROM units GROUP BY v),
          s AS (SELECT a.point, b.point AS other, round(list_inner_product(a.v, b.v), 12) AS score FROM p a JOIN p b ON a.point <> b.point)
          SELECT point, CAST(rank AS INTEGER) AS rank, other, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY score DESC, other) AS rank FROM s) WHERE rank <= 15""",
        "index_stats": "SELECT count(*) AS index_size, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim FROM embeddings",
        "faithfulness": f"WITH {FAITH} SELECT conv_id, turn, CAST(faithfulness AS DOUBLE) AS faithfulness FROM faith",
        "kind_split": f"WITH {TWO} SELECT vec_id, CASE WHEN block_type = 'chart' THEN 1 ELSE 2 END AS branch FROM k",
        "chart_analysis": f"""WITH {PROBS % 9}, b AS (SELECT vec_id, list_position(p, list_max(p)) AS place, list_max(p) AS m FROM p),
          o AS (SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(replace(coalesce(text, ''), '. ', {NL}), {NL}), lambda x: trim(x, {S})), lambda x: length(x) > 2 OR regexp_matches(x, '^{DIGIT}+$')), {NL}), '') AS ocr FROM documents),
          w AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(ocr, '[а-яА-ЯёЁa-zA-Z]{{3,}}') AS w FROM o)),
          u AS (SELECT doc_id, min(i) AS i, min_by(w[i + 1], i) AS word FROM w GROUP BY doc_id, lower(w[i + 1])), k AS (SELECT doc_id, (list(word ORDER BY i))[1:8] AS words FROM u GROUP BY doc_id)
          SELECT vec_id, CAST(vec_id % 7 AS INTEGER) AS page_num, ({KINDS})[place] AS chart_subtype, ({LABELS})[place] AS chart_subtype_ru, round(m, 4) AS confidence, substr(ocr, 1, 200) AS ocr_text,
            ({LABELS})[place] || CASE WHEN vec_id % 2 = 0 THEN '. (BLIP: a chart)' ELSE '' END || CASE WHEN len(words) > 0 THEN '. Ключевые слова: ' || array_to_string(words, ', ') ELSE '' END || '.' AS gpt_description,
            vec_id % 5 > 2 AS has_lines, length(trim(ocr, {S})) > 10 AS has_text, 'c' || vec_id || '.png' AS image_path FROM b JOIN o ON o.doc_id = vec_id LEFT JOIN k ON k.doc_id = vec_id""",
        "ordered_blocks": f"""WITH {BLOCKS}, every AS (
            SELECT doc_id, 0 AS branch, 0 AS later, block_no, page_num, block_type FROM blocks
            UNION ALL SELECT vec_id % 50, CASE WHEN label % 2 = 0 THEN 1 ELSE 2 END, vec_id % 7 + 1, vec_id, CAST(vec_id % 7 + 1 AS INTEGER), CASE WHEN label % 2 = 0 THEN 'chart' ELSE 'image' END FROM embeddings)
          SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY branch, later, block_no) - 1 AS INTEGER) AS block_no, page_num, block_type FROM every""",
        "index_cycle": f"WITH {VECS} SELECT CASE WHEN row_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, 'c' || row_id AS chunk_id, type, page, section, round(sqrt(list_inner_product(v, v)), 6) AS length FROM units",
        "index_cleared": "SELECT 'odd' AS source, 'c' || vec_id AS chunk_id FROM embeddings WHERE vec_id % 2 = 1",
        "top_sources": f"WITH {BATCH} SELECT query_id, rank, chunk_id, substr(text, 1, 100) AS text_preview FROM hits WHERE rank <= 3",
        "ingest_stats": f"""WITH RECURSIVE {chunks} SELECT (SELECT count(*) FROM pieces WHERE length(text) >= 50) AS index_size, 384 AS embedding_dim, false AS llm_available, 'gpt-oss-20b' AS llm_model,
          (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT block_type || '=' || count(*) AS t FROM blocks GROUP BY block_type)) AS blocks""",
        "markdown_saved": f"WITH {MARKDOWN} SELECT doc_id, markdown FROM markdowns",
        "results_saved": f"""WITH RECURSIVE {METRICS} SELECT conv_id, turn, CAST(bleu AS DOUBLE) AS bleu, CAST(rouge_l AS DOUBLE) AS rouge_l, CAST(faithfulness AS DOUBLE) AS faithfulness
          FROM bleus JOIN rouges USING (conv_id, turn) JOIN faith USING (conv_id, turn)""",
        "sample_bench": f"""WITH RECURSIVE {METRICS.replace(PAIRS, SAMPLES)} SELECT question, reference, substr(answer, 1, 200) AS answer, category, 'echo' AS model, CAST(bleu AS DOUBLE) AS bleu, CAST(rouge_l AS DOUBLE) AS rouge_l, CAST(faithfulness AS DOUBLE) AS faithfulness
          FROM pairs JOIN bleus USING (conv_id, turn) JOIN rouges USING (conv_id, turn) JOIN faith USING (conv_id, turn)""",
        "rouge_l": f"WITH RECURSIVE {ROUGE} SELECT conv_id, turn, CAST(rouge_l AS DOUBLE) AS rouge_l FROM rouges",
        "bench_summary": f"""WITH RECURSIVE {METRICS}
          SELECT count(*) AS questions, round(avg(CAST(bleu AS DOUBLE)), 4) AS avg_bleu, round(avg(CAST(rouge_l AS DOUBLE)), 4) AS avg_rouge_l, round(avg(CAST(faithfulness AS DOUBLE)), 4) AS avg_faithfulness
          FROM bleus JOIN rouges USING (conv_id, turn) JOIN faith USING (conv_id, turn)""",
        "rag_answers": answered,
        "bleu2": f"WITH {BLEU} SELECT conv_id, turn, CAST(bleu AS DOUBLE) AS bleu FROM bleus",
    }
    # Other ways to the same rows.
    as_text = {f"{x}_sql": found[x] for x in ("block_classify", "chunk_sections", "faithfulness")}
    return found | as_text | {"chunk_long": found["chunk_sections"], "stream_dedup_number": found["dedup_limit_number"]}
