import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import neighbour_map
from docspark.plans import shared
from docspark.sources import backends

SF = "/root/testdata/sf0.01"
INDEX = "row_id bigint, vec array<double>, point string, x int"


def made(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v], "clash", 1) for k, v in rows], INDEX)


def clusters(n, dim=12, groups=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return np.repeat(np.arange(groups), n // groups), np.concatenate([c + 0.15 * rng.normal(size=(n // groups, dim)) for c in centres])


def test_nearest_equals_brute_force(spark):
    _, x = clusters(120)
    rows = [(i, v) for i, v in enumerate(x)] + [(200 + i, 2 * x[0]) for i in range(40)]  # copies of one direction are one point
    rows += [(300, None), (301, [None] * 12), (302, [float("nan")] * 12), (303, [float("inf")] * 12), (304, [1, 2])]
    found, members = neighbour_map.points(made(spark, rows).repartition(3))
    of = {r.row_id: r.point for r in members.collect()}
    assert {of[200 + i] for i in range(40)} == {0} and not {300, 301, 302, 303} & set(of)
    got = {}
    for r in neighbour_map.nearest(found, 7).collect():
        got.setdefault(r.point, {})[r["rank"]] = r.other
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -9)
    assert got == {i: dict(enumerate(np.argsort(-score[i], kind="stable")[:7].tolist(), 1)) for i in range(120)}


def test_chances_have_the_perplexity():
    away = np.random.default_rng(0).uniform(0.1, 2, (50, 15))
    away[0, 4:] = np.inf  # fewer than the perplexity
    away[1] = 0.5  # ties
    p = neighbour_map.chances(away, 5.0)
    entropy = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(1)
    assert np.allclose(p.sum(1), 1) and np.allclose(np.exp(entropy[2:]), 5, atol=1e-6)
    assert np.allclose(p[0, :4], 0.25) and not p[0, 4:].any() and np.allclose(p[1], 1 / 15)


def test_a_round_is_the_gradient(spark):
    """With a sample of all places a round's moves are those of the full sums."""
    rng = np.random.default_rng(4)
    y, v = rng.normal(size=(2, 30, 2))
    pairs = {(a, b): float(rng.uniform()) for a in range(29) for b in rng.integers(0, 29, 4).tolist() if a != b}  # 29 has no edge
    places = spark.createDataFrame([(i, *map(float, (*y[i], *v[i]))) for i in range(30)], neighbour_map.PLACE)
    pull = spark.createDataFrame([(*k, w) for k, w in pairs.items()], "a bigint, b bigint, weight double")
    got = {r.point: (r.x, r.y) for r in neighbour_map.moved(places.repartition(4), pull, 0, 100, 0, 0.5, 0.8, 1.5).collect()}
    step = y[:, None] - y
    near = 1 / (1 + (step**2).sum(2))
    force = ((near**2)[:, :, None] * step).sum(1) / (30 * near.mean())
    for (a, b), w in pairs.items():
        force[a] -= w * near[a, b] * step[a, b]
    move = 0.8 * v + 0.5 * force
    move *= np.minimum(1, 1.5 / np.linalg.norm(move, axis=1, keepdims=True))
    assert len(got) == 30 and np.allclose([got[i] for i in range(30)], y + move, atol=1e-6)


def test_neighbours_stay_neighbours(spark):
    """More of them than with principal components, on vectors with and without clusters; any partitions, one result."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = {r.row_id: np.array(r.vec) for r in e.collect()}
    ids = sorted(rows)
    x = np.stack([rows[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    trust = lambda xy: neighbour_map.trustworthiness(x, np.array([xy[i] for i in ids]))
    got = {r.row_id: (r.x, r.y) for r in neighbour_map.plane(e).collect()}
    linear = {r.row_id: list(r.xy) for r in backends.project(e).collect()}
    assert trust(got) > trust(linear) + 0.03


def test_clusters_and_partitions(spark):
    group, x = clusters(120)
    rows = made(spark, list(enumerate(x)))
    one, other = ({r.row_id: (r.x, r.y) for r in neighbour_map.plane(df, neighbours=6, rounds=12, sample=64).collect()} for df in (rows, rows.repartition(5)))
    assert one == other
    xy = np.array([one[i] for i in range(120)])
    away = ((xy[:, None] - xy) ** 2).sum(2)
    np.fill_diagonal(away, np.inf)
    assert (group[away.argmin(1)] == group).mean() > 0.95


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [3, 4])], [(1, [3, 4]), (2, [6, 8])], [(1, [0, 0]), (2, [1, 0])], [(1, [1]), (2, [-1])]])
def test_few_rows(spark, rows):
    got = {r.row_id: (r.x, r.y) for r in neighbour_map.plane(made(spark, rows), rounds=2).collect()}
    assert set(got) == {k for k, v in rows if v} and np.isfinite(list(got.values())).all()
    if len(rows) == 2 and rows[0][1] == [3, 4]:
        assert got[1] == got[2]  # equal directions share a place


def test_rounds_leave_no_shuffle_files(spark):
    def left():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in str(blocks.mkString(" ")).split() if b.startswith("shuffle_")}

    _, x = clusters(120)
    df = made(spark, list(enumerate(x))).repartition(3)
    before, setting = left(), spark.conf.get(shared.CLEAN_UP, None)
    kept = neighbour_map.plane(df, rounds=2)
    assert kept.count() == 120 and spark.conf.get(shared.CLEAN_UP, None) == setting
    assert len({b.split("_")[1] for b in left() - before}) <= 2  # the last count's, not a few for each round
