import math

import numpy as np
from pyspark.sql import functions as F

from docspark.operators import charts, colour_clusters

PIXELS = "image int, r int, g int, b int, n string, cluster int"


def made(spark, rows):
    return spark.createDataFrame([(*row, "x", 9) for row in rows], PIXELS)  # clashing names aren't read


def rounds_of(points, n, centres, rounds):
    for _ in range(rounds):
        near = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([np.average(points[near == i], axis=0, weights=n[near == i]) if (near == i).any() else c for i, c in enumerate(centres)])
    near = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    return [(i, *np.average(points[near == i], axis=0, weights=n[near == i]).astype(int).tolist(), int(n[near == i].sum())) for i in range(len(centres)) if (near == i).any()]


def test_equals_rounds_of_each_image(spark):
    rng = np.random.default_rng(3)
    rows = [(image, *rng.integers(0, 256, 3).tolist()) for image, size in ((1, 400), (2, 60), (3, 9)) for _ in range(size)]
    rows += rows[:150]  # repeated colours count as often as they stand there
    pixels = made(spark, rows)
    counts = colour_clusters.colour_counts(pixels, "image").cache()
    start = {r.image: np.array([list(c) for c in r.centres]) for r in colour_clusters.seeds(counts, "image", 4).collect()}
    got = {tuple(r) for r in colour_clusters.clusters(pixels.repartition(7), "image", 4, 6).collect()}
    want = set()
    for image, seeds in start.items():
        assert len(np.unique(seeds, axis=0)) == 4
        own = [r for r in counts.filter(F.col("image") == image).orderBy("r", "g", "b").collect()]
        points, n = np.array([[r.r, r.g, r.b] for r in own], float), np.array([r.n for r in own])
        want |= {(image, *row) for row in rounds_of(points, n, seeds, 6)}
    assert got == want


def test_seeds_follow_distance_and_pixels(spark):
    """Over many images of the same three places of colours, the far place is drawn second almost always, the near one hardly."""
    rows = [(image, *c) for image in range(60) for c in ((10 + image, 10, 10), (12 + image, 10, 10), (250, 250, 250 - image))]
    drawn = {r.image: [tuple(map(int, c)) for c in r.centres] for r in colour_clusters.seeds(colour_clusters.colour_counts(made(spark, rows), "image"), "image", 2).collect()}
    apart = sum(math.dist(*c) > 100 for c in drawn.values())
    assert len(drawn) == 60 and apart >= 58 and len({c[0][0] >= 250 for c in drawn.values()}) == 2


def test_cases(spark):
    rows = [(1, 200, 10, 10)] * 3 + [(2, 0, 0, 250), (2, 250, 0, 0), (None, 1, 1, 1), (3, None, 1, 1)]
    got = [tuple(r) for r in colour_clusters.clusters(made(spark, rows), "image").orderBy("image", "r").collect()]
    assert [(r[0], *r[2:]) for r in got] == [(1, 200, 10, 10, 3), (2, 0, 0, 250, 1), (2, 250, 0, 0, 1)]
    assert colour_clusters.clusters(made(spark, rows).filter("false"), "image", 3, 2).count() == 0
    said = charts.dominant_colors(colour_clusters.clusters(made(spark, rows), "image", 2, 2), "image").orderBy("image").collect()
    assert said[0].dominant_colors == ["цветной (#c80a0a, 100%)"] and said[1].num_color_segments == 2
