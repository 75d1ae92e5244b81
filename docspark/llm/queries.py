"""The queries over the testing tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import conversation_repair, exact_dedup, filtering_lloyd, html_text, language_id, ngram_join, packing, pieces, quality_classifier, quality_rules, sharding, voronoi_join, warc
from docspark.llm.common import doc_bucket, stash, table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + F.lit(8)).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = sharding.shuffle_into_shards(rows, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def language_model(docs: DataFrame):
    """Learned from the rows that may be learned from."""
    import public_tokenizers as files

    texts, langs = language_id.sample(docs.filter(doc_bucket(F.col("doc_id"), 3) != 1), 1500)
    return language_id.train(texts, langs, files.path("byte_bpe_multi_50k.tiktoken"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return language_id.identify(docs.select("doc_id", (doc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "text"), language_model(docs))


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers as files

    return {"tokenizer": files.path("byte_bpe_50k.json"), "ranks": files.path("byte_bpe_50k.tiktoken"), "pattern": files.PATTERN}


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer_files())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def read_whole(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records of archives just written; an error where they aren't as many."""
    found = stash(warc.read(spark, manifest), "records")
    written, whole = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], found.filter("record_type <> 'gap'")
    if (n := whole.count()) != written:
        gaps = found.filter("record_type = 'gap'").select("file", "start", "gap").limit(5).collect()
        raise RuntimeError(f"{written} records written, {n} read; gaps: {gaps}")
    return whole


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_whole(spark, warc.write(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def quality_model(docs: DataFrame, labels: DataFrame):
    """Learned from the rows that may be learned from."""
    return quality_classifier.fit(docs, labels.filter(doc_bucket(F.col("doc_id"), 4) != 2))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs.select("doc_id", (doc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), ranker)
    return scored.withColumn("predicted", (F.col("score") >= quality_classifier.AT).cast("int"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.map_ids(docs, files.path("piece_bpe_32k.model"), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", pieces.digests)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.digests(rows).withColumnRenamed("id", "conv_id")


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_join.knn_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering_lloyd.compress(table(spark, sf_dir, "embeddings"))


QUERIES = [
    op1_ngram_join, op2_html_extraction, op3_sharding, op4_language_id, op5_packing, op6_quality_rules, op7_warc, op8_quality_classifier, op9_exact_dedup, op10_sentencepiece,
    op11_conversation_repair, op12_topk_search, op13_vector_codes,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents
), g AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS group_size, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM g
"""


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), sizes AS (
  SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id
)
SELECT z.doc_id, z.n AS n_shingles, min(r.root) AS component_id FROM sizes z JOIN reach r USING (doc_id) GROUP BY z.doc_id, z.n
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM g
"""


#: crc32 bit by bit; a row for each state, the cheapest edits as text.
OP11_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k
  FROM conversations
), h AS (
  SELECT *, xor(list_reduce(list_transform(range(octet_length(k)), lambda i: ord(k[i + 1:i + 1]::VARCHAR)::UBIGINT), lambda crc, b:
    list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, o: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS what
  FROM c
), d AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM d
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, role[1] AS r, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM n
), f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au'), false) AS bad
  FROM o
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id
), lead AS (
  SELECT * FROM (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (2, 2, 'II'), (3, 3, ''), (3, 2, 'I'), (3, 3, 'II')) t(p, m, lead)
), edits AS (
  SELECT * FROM (VALUES (0, 's', 'K', 1), (0, 'u', 'K', 2), (1, 'u', 'K', 2), (2, 'a', 'K', 3), (3, 'u', 'K', 2),
                        (0, '*', 'R', 2), (1, '*', 'R', 2), (2, '*', 'R', 3), (3, '*', 'R', 2), (0, '*', 'D', 0), (1, '*', 'D', 1), (2, '*', 'D', 2), (3, '*', 'D', 3)) t(m, role, edit, q)
), ways AS (
  SELECT f.conv_id, f.i, l.p, e.q, 5 * length(l.lead) + CASE e.edit WHEN 'K' THEN 0 WHEN 'R' THEN 1 ELSE 2 END + CASE WHEN fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END AS cost, l.lead || e.edit AS edits
  FROM f JOIN edits e ON e.role IN ('*', f.r) AND (e.edit = 'D' OR fault NOT IN ('blank', 'duplicate')) JOIN lead l ON l.m = e.m
), best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit FROM g
  UNION ALL
  SELECT b.conv_id, b.i + 1, w.q, min(b.cost + w.cost), arg_min(b.audit || w.edits, (b.cost + w.cost, b.audit || w.edits))
  FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i + 1 AND w.p = b.q GROUP BY b.conv_id, b.i, w.q
), ended AS (
  SELECT b.conv_id, arg_min((b.cost + 5 * e.n)::BIGINT, (b.cost + 5 * e.n, b.audit || repeat('I', e.n))) AS cost, arg_min(b.audit || repeat('I', e.n), (b.cost + 5 * e.n, b.audit || repeat('I', e.n))) AS audit
  FROM best b JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND g.n = b.i JOIN (VALUES (0, 0), (1, 2), (2, 1), (3, 0)) e(q, n) ON e.q = b.q GROUP BY b.conv_id
), letters AS (
  SELECT conv_id, audit[k] AS edit, k, length(replace(audit[1:k], 'I', '')) AS i FROM ended, range(1, length(audit) + 1) t(k)
), placed AS (
  SELECT l.conv_id, l.k, l.edit, f.role, f.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k) - max(CASE WHEN edit = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS n
  FROM letters l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.edit <> 'I' WHERE edit <> 'D'
), said AS (
  SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS whole FROM placed GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
"""

OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM v q JOIN v x ON q.r <> x.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round as tables of its own: assignments p, and entries b."""
    with_parts = f"""
v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM v, range({parts}) t(p)
), b0 AS MATERIALIZED (
  SELECT p, r AS e, x AS b FROM x WHERE r < {entries}
)"""
    assigned = """
p{k} AS MATERIALIZED (
  SELECT r, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT r, p, x, e, list_sum(list_transform(list_zip(x, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{k} USING (p)
  ) GROUP BY r, p, x
)"""
    moved = """
m{k} AS MATERIALIZED (
  SELECT p, e, list(floor_sum ORDER BY j) AS b FROM (
    SELECT p, e, j, (CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END)::BIGINT AS floor_sum
    FROM (SELECT p, e, j, sum(x[j])::HUGEINT AS s, count(*) AS n FROM p{k}, (SELECT unnest(range(1, len(x) + 1)) AS j FROM (SELECT x FROM x LIMIT 1)) GROUP BY p, e, j)
  ) GROUP BY p, e
), b{n} AS MATERIALIZED (
  SELECT p, e, coalesce(m{k}.b, b{k}.b) AS b FROM b{k} LEFT JOIN m{k} USING (p, e)
)"""
    steps = [with_parts]
    for k in range(rounds):
        steps += [assigned.format(k=k), moved.format(k=k, n=k + 1)]
    return (
        "WITH "
        + ",".join([*steps, assigned.format(k=rounds)])
        + f""", coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM p{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN v USING (r)
"""
    )


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op7_warc": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_topk_search": OP12_SQL, "op13_vector_codes": _op13_sql()}
