import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from docspark.llm import exact_dedup, queries


def brute(rows):
    groups = {}
    for i, r in enumerate(rows):
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        groups.setdefault(key, []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, i))
    return {hashlib.sha256(k.encode()).hexdigest(): (rows[min(v)[3]][0], len(v)) for k, v in groups.items()}


def test_matches_brute_force(docs, rows):
    got, want = exact_dedup.decide(docs).collect(), brute(rows)
    assert len(got) == len(rows)
    assert {r.text_sha256 for r in got} == set(want)
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_heavy_and_light_ways_agree(docs):
    light = sorted(map(tuple, exact_dedup.decide(docs, candidates=1, counters=64).collect()), key=repr)
    assert light == sorted(map(tuple, exact_dedup.decide(docs).collect()), key=repr)


def test_hot_digest_stays_map_side(spark):
    hot = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot text', concat('t', id)) as text")
    got = exact_dedup.decide(hot).filter("kept")
    assert got.count() == 1 + 4000 - 1334
    assert got.filter("group_size > 1").first()[:3] == (0, 0, 1334)


def test_stage_keeps_rows_and_columns(docs, rows):
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns
    got = out.collect()
    want = {k: v[0] for k, v in brute(rows).items()}
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, want.values()))


def test_ids_and_columns_of_all_kinds(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(low, "a b", {"k": 1}, "p"), (high, "ab", {}, "q"), (7, "x", None, "r"), (7, "x ", {"z": 2}, "s"), (7, "y", {}, None), (8, "y", {}, "t"), (None, "n", {}, "u"), (None, "n", {}, "u"), (None, None, {}, "v")]
    own = spark.createDataFrame(rows, "doc_id bigint, text string, __own map<string,int>, __id string").withColumn("__sha", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("whole", F.lit(3))
    got = exact_dedup.keep_first(own)
    assert got.columns == own.columns
    assert sorted(map(repr, (tuple(r)[:2] for r in got.collect()))) == sorted(map(repr, [(low, "a b"), (7, "x "), (7, "y"), (None, "n"), (None, None)]))
    assert sorted(map(repr, (r[:2] for r in map(tuple, exact_dedup.keep_first(own, most_broadcast=0).collect())))) == sorted(map(repr, (tuple(r)[:2] for r in got.collect())))
    assert {r.keep_id for r in exact_dedup.decide(own).collect()} == {low, 7, None}


def test_sql(spark, tmp_path):
    """The query, on a small table, against its own SQL."""
    rows = [(k, t) for k, t in enumerate(["a b", "ab", " ab ", "ab  ", "", None, "\t", "c", "nbsp\u00a0", "nbsp", "é", "x" * 20000, "x" * 20000 + "\n"] * 2)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        want = db.sql(queries.OP9_SQL).fetchall()
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, queries.op9_exact_dedup(spark, str(tmp_path)).select(names).collect())) == sorted(want)


def test_empty(empty):
    assert exact_dedup.decide(empty).count() == 0
    assert exact_dedup.keep_first(empty).count() == 0
