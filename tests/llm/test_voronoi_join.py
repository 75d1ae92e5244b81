import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import queries, voronoi_join
from docspark.llm.vectors import packed, products, unpacked

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, grp string, score double, rno string, asked int"


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, k, asks):
    width = max([len(r[1]) for r in rows if r[1] is not None], default=0)
    kept = [(i, r[0], [math.floor(256 * x) for x in r[1]] + [0] * (width - len(r[1]))) for i, r in enumerate(rows) if fine(r[1])]
    out = []
    for i, q, v in kept:
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), x is None, x or 0) for j, x, w in kept if j != i)
            out += [(q, n + 1, None if none else x, -s) for n, (s, none, x) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def ran(spark, rows, k=5, **how):
    df = spark.createDataFrame([(i, v, 1, "x", "g", 0.5, "r", 2) for i, v in rows], SCHEMA)
    found = voronoi_join.knn_join(df.repartition(3), F.col("vec_id") % 50 == 0, k, **how)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def asked(q):
    return q is not None and q % 50 == 0


def clustered(n, d, seed=0, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return [(i, (centres[i % 12] + spread * rng.normal(size=d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("pivots", [1, 4, 64])
def test_matches_brute_force(spark, pivots):
    rows = clustered(1200, 6)
    assert ran(spark, rows, most_pivots=pivots) == brute(rows, 5, asked)


def test_defined_cases(spark):
    rows = clustered(160, 4, 1)
    rows += [(200, None), (250, [float("nan")] * 4), (300, [1.0, None, 0.0, 0.0]), (301, [float("inf"), 0.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0, 9.0]), (None, [9.0, 9.0, 9.0, 9.0])]
    rows += [(350, []), (400, [0.5]), (50, rows[7][1]), (50, rows[7][1]), (450, [0.0] * 4)]  # short vectors, repeated ids, zeros
    assert ran(spark, rows) == brute(rows, 5, asked)
    assert ran(spark, rows, k=1000) == brute(rows, 1000, asked)
    assert ran(spark, []) == [] and ran(spark, [(1, [1.0])]) == [] and ran(spark, [(0, [1.0])]) == [] and ran(spark, [(0, None)]) == []
    with pytest.raises(Exception, match="times 256"):
        ran(spark, [(0, [1e9]), (1, [1.0])])


def test_ties_and_a_hot_vector(spark):
    rows = clustered(3000, 3, 2)
    rows = [(i, [1.0, 0.5, -1.0]) if i % 3 == 0 else (i, v) for i, v in rows]
    assert ran(spark, rows) == brute(rows, 5, asked)


def test_rows_go_to_few_groups(spark):
    rows = clustered(4000, 16, 3, 0.05)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    sent, plain = [], voronoi_join._sent

    def counted(*args):
        out = plain(*args)
        sent.append(out.agg(F.sum(F.octet_length("known"))).first()[0])
        return out

    voronoi_join._sent = counted
    try:
        voronoi_join.knn_join(df, F.col("vec_id") % 50 == 0).count()
    finally:
        voronoi_join._sent = plain
    assert sent[0] < 4000 * 3  # 12 clusters, and a group or more of each; all rows to all groups would be 48000 at least


def test_few_groups_where_nothing_can_be_told_apart():
    rng = np.random.default_rng(5)
    sphere = rng.normal(size=(1000, 64))
    sphere = np.floor(256 * sphere / np.linalg.norm(sphere, axis=1, keepdims=True)).astype(np.int64)
    assert len(voronoi_join.choose_pivots(sphere, 5, 1000, 256)) == 1
    apart = np.array([np.floor(np.array(v) * 256) for _, v in clustered(1000, 16, 3, 0.05)]).astype(np.int64)
    assert len(voronoi_join.choose_pivots(apart, 5, 1000, 256)) >= 12


def test_numbers_survive_packing():
    for most in (100, 1 << 20, 1 << 40):
        x = np.random.default_rng(1).integers(-most, most, (7, 3))
        assert (unpacked(packed(x), 3) == x).all()
    big = np.array([[1 << 26, -(1 << 26)]])
    assert products(big, big)[0, 0] == 1 << 53 and products(big[:0], big).shape == (0, 1)


def test_query_and_its_sql(spark, tmp_path):
    spark.createDataFrame([(i, v, i % 4) for i, v in clustered(400, 8, 4)], "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = queries.op12_topk_search(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(queries.OP12_SQL).fetchall())


def test_queries_are_never_broadcast(spark):
    df = spark.createDataFrame(clustered(300, 6), "vec_id bigint, embedding array<double>")
    plan = voronoi_join.knn_join(df, F.col("vec_id") % 50 == 0)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_slices_cover_all_tasks_and_move_little():
    for tasks, groups, queries, rows in [(600, 1, 14_400, 720_000), (12, 5, 3, 100), (1, 1, 1, 1), (8, 64, 500, 500)]:
        down, across = voronoi_join.grid(tasks, groups, queries, rows)
        assert down * across * groups >= tasks
        assert rows * across + queries * down <= rows + queries * -(-tasks // groups)  # queries in every slice of rows, as before


def test_best_hits_over_blocks_in_any_precision():
    rng = np.random.default_rng(3)
    for most in (9, 1 << 20):
        x = rng.integers(-most, most, (400, 4))
        rno, known = np.arange(400), rng.random(400) < 0.9
        ids = np.where(known, rng.permutation(400) // 3, 0)
        best = voronoi_join.Best(rno[:70], ids[:70], known[:70], 5)
        for at in (0, 3, 100, 250):
            some = slice(at, {0: 3, 3: 100, 100: 250, 250: 400}[at])
            best.add(voronoi_join._scores(x[some], x[:70]), rno[some], ids[some], known[some])
        got = best.batch().to_pydict()
        for q in range(70):
            want = sorted((-int(x[q] @ x[i]), not known[i], ids[i], i) for i in range(400) if i != q)[:5]
            mine = [(-s, v is None, v or 0) for n, s, v in zip(got["qno"], got["score"], got["vec_id"], strict=True) if n == q]
            assert mine == [w[:3] for w in want]
