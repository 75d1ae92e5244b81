import zlib
from collections import Counter

import numpy as np

from docspark.llm import queries, sharding


def test_sizes_slots_and_rows(docs, rows):
    out = sharding.shuffle_into_shards(docs, 7)
    got = out.collect()
    assert set(out.columns) == set(docs.columns)
    counts = Counter(r.shard for r in got)
    assert sum(counts.values()) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)


def test_matrix_has_exact_margins_and_the_hypergeometric_mean():
    counts = [10, 0, 25, 7, 3]
    total = np.zeros((5, 4))
    for seed in range(400):
        m = sharding.draw_matrix(counts, 4, seed)
        assert m.sum(1).tolist() == counts and sorted(m.sum(0).tolist()) == [11, 11, 11, 12]
        total += m
    assert np.abs(total / 400 - np.array(counts)[:, None] * np.array([12, 11, 11, 11]) / 45).max() < 0.35


def test_large_draw_is_exact_in_mean_and_range():
    rng = np.random.default_rng(1)
    draws = [sharding._large_draw(rng, 3 * 10**9, 7 * 10**9, 1000) for _ in range(200)]
    assert abs(np.mean(draws) - 300) < 5


def test_shuffle_is_uniform(spark):
    df = spark.range(6, numPartitions=2)
    seen = Counter()
    for seed in range(40):
        for r in sharding.shuffle_into_shards(df, 2, seed).collect():
            seen[r.id, r.shard] += 1
    assert all(8 <= seen[i, s] <= 32 for i in range(6) for s in range(2))


def test_query(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_sharding(spark, str(tmp_path)).collect()
    raw = [(r[1] or "").encode() for r in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len(x) + 8, zlib.crc32(x)) for r, x in zip(rows, raw, strict=True))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)} and {r.shard for r in got} <= set(range(24))
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())


def test_columns_that_clash_stay(docs):
    own = docs.selectExpr("doc_id", "text", "1 as __key", "2 as __id", "3 as `a.b`", "map('k', 1) as m", "4 as p", "5 as whole", "'old' as shard")
    got = sharding.shuffle_into_shards(own, 3)
    assert got.columns == ["doc_id", "text", "__key", "__id", "a.b", "m", "p", "whole", "shard", "slot"]
    assert got.filter("__key = 1 and __id = 2 and `a.b` = 3 and m['k'] = 1 and p = 4 and whole = 5 and shard between 0 and 2").count() == docs.count()


def test_empty(empty):
    assert sharding.shuffle_into_shards(empty, 3).count() == 0
