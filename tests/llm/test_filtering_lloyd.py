import hashlib
import math

import duckdb
import numpy as np
import pytest

from docspark.llm import filtering_lloyd as fl
from docspark.llm import queries

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, error string, id int, entry int, n int"


def brute(rows, parts=8, entries=16, rounds=6):
    """In Python's own whole numbers."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max([len(r[1]) for r in rows if r[1] is not None], default=0)
    width = max(parts, -(-width // parts) * parts)
    d = width // parts
    kept = sorted(((r[0] is None, r[0] or 0, [math.floor(4096 * x) for x in r[1]] + [0] * (width - len(r[1])), r[2]) for r in fine), key=lambda k: k[:3])
    if not kept:
        return []
    books = [[list(k[2][p * d : p * d + d]) for k in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for k in kept:
                x = k[2][p * d : p * d + d]
                groups.setdefault(near(x, books[p])[1], []).append(x)
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], {}
    for none, i, v, label in kept:
        best = [near(v[p * d : p * d + d], books[p]) for p in range(parts)]
        error = sum(b[0] for b in best)
        by_label[label] = by_label.get(label, 0) + error
        out.append((None if none else i, "".join(f"{b[1]:02x}" for b in best), error, label))
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], sha) for i, c, e, label in out), key=repr)


def ran(spark, rows):
    df = spark.createDataFrame([(i, v, label, "c", "e", 1, 2, 3) for i, v, label in rows], SCHEMA)
    found = fl.compress(df.repartition(3))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


def made(n, d, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d))
    return [(i, (centres[i % 9] + 0.3 * rng.normal(size=d)).tolist(), [None, 0, 1, 5][i % 4]) for i in range(n)]


@pytest.mark.parametrize("shape", [(1, 1, 1), (40, 2, 3), (900, 3, 16), (5000, 8, 16)])
@pytest.mark.parametrize("scale", [2, 5000])
def test_filter_equals_plain_search(shape, scale):
    n, d, entries = shape
    rng = np.random.default_rng(n)
    points = rng.integers(-scale, scale, (n, d))
    book = points[rng.integers(0, n, entries)] if scale == 2 else rng.integers(-scale, scale, (entries, d))
    order, starts, held = fl.build(points)
    assert (points[order] == held).all() and np.diff(starts[-1]).max() <= max(fl.LEAF, 1)
    whole, place, entry = fl.filtered(starts, fl.summed(held, starts), held, book)
    found = np.full(n, -1)
    found[place] = entry
    for level, node, of in whole:
        for i, e in zip(node, of, strict=True):
            assert (found[starts[level][i] : starts[level][i + 1]] == -1).all()
            found[starts[level][i] : starts[level][i + 1]] = e
    assert (found == ((held[:, None] - book) ** 2).sum(2).argmin(1)).all()


def test_whole_subtrees_are_assigned_at_once():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = centres[rng.integers(0, 16, 8000)] + rng.integers(-200, 200, (8000, 8))
    _, starts, held = fl.build(points)
    _, place, _ = fl.filtered(starts, fl.summed(held, starts), held, centres)
    assert len(place) < 0.3 * len(points)


def test_matches_brute_force(spark):
    rows = made(600, 16)
    assert ran(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = made(60, 10, 1)  # not a multiple of eight
    rows += [(100, None, 1), (101, [float("nan")] * 10, 1), (102, [None] * 10, 1), (103, [float("-inf")] + [0.0] * 9, 1), (-1, [0.5], 7), (None, [1.0] * 10, None), (None, [0.0] * 10, 5)]
    rows += [(3, rows[3][1], 2), (3, rows[5][1], 2), (104, [], 0)]
    assert ran(spark, rows) == brute(rows)
    assert ran(spark, rows[:5]) == brute(rows[:5])  # fewer rows than entries
    assert ran(spark, []) == [] and ran(spark, [(1, None, 1)]) == []
    same = [(i, [0.25] * 8, 0) for i in range(40)]  # ties go to entry 0; the others stay unused
    assert ran(spark, same) == brute(same) and {r[1] for r in ran(spark, same)} == {"00" * 8}
    with pytest.raises(Exception, match="times 4096"):
        ran(spark, [(0, [1e9] * 8, 1)])


def test_query_and_its_sql(spark, tmp_path):
    spark.createDataFrame(made(300, 16, 4), "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = queries.op13_vector_codes(spark, f"file://{tmp_path}")
    want = con.sql(queries.oracle_sql()["op13_vector_codes"])
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(want.fetchall())
