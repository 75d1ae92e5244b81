"""A plane view of the index in which neighbours stay neighbours (the aim of t-SNE).

Equal vectors are one point. Each point's nearest others come from the clustered index, exactly; a point's chances of
picking each of them have a given perplexity, and both directions of a pair are averaged. Points begin at their first
two principal components and move in rounds: towards their neighbours, by a join of edges and positions, and away from
all others, by a sample of positions that is drawn anew in each round and goes to all tasks. The sample's size is a
parameter, so what is sent doesn't grow with the index; edges are shuffled twice a round, once to either end, and what a
round has shuffled is removed when it ends.

Forces are added up as whole numbers and samples drawn by hash, so the same rows, parameters and seed give the same map
however rows are dealt out. Finding all neighbours costs what `clustered` can't leave out: for vectors without structure
that grows with the square of the index.

Defined cases: rows without a vector, with a null or non-finite component, or of another dimension than most, have no
place; vectors count over their lengths; equal vectors share a place; a lone point lies at its principal components,
which are 0. Other columns aren't read. Keys are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import let
from docspark.functions.vectors import dot, norm, unit
from docspark.operators import clustered
from docspark.plans.shared import drop_stash, shuffles_removed, stash

#: Forces are whole multiples of 2^-32 where they are added up.
UNIT = float(1 << 32)
PLACE = "point bigint, x double, y double, vx double, vy double"


def points(index: DataFrame, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """((point, vec), (key, point)), written: distinct unit vectors, named by their smallest key, and each row's point."""
    finite = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Each vector and its length are bound once: Catalyst would work out a column's length again for every component.
    over = let(F.col("vec").cast("array<double>"), lambda v: let(norm(v), lambda n: unit(v, n)))
    rows = index.filter(finite).select(F.col(key).cast("bigint").alias(key), over.alias("vec"))
    found = stash(rows.groupBy("vec").agg(F.min(key).alias("point")).select("point", "vec"), "points")
    return found, stash(rows.join(found, "vec").select(key, "point"), "members")


def nearest(found: DataFrame, neighbours: int) -> DataFrame:
    """(point, rank, other, score): each point's nearest others by inner product, ties by key."""
    best, _ = clustered.top_k(clustered.build(found, "point"), found.withColumnRenamed("point", "own"), neighbours + 1, "point", "own")
    own = F.struct("rank", F.col("point").alias("other"), "score")
    lists = best.filter("own != point").groupBy("own").agg(F.array_sort(F.collect_list(own)).alias("near"))  # neighbours + 1 entries at most
    return lists.select(F.col("own").alias("point"), F.posexplode(F.slice("near", 1, neighbours)).alias("at", "n")).select("point", (F.col("at") + 1).alias("rank"), "n.other", "n.score")


def chances(away: np.ndarray, perplexity: float) -> np.ndarray:
    """For rows of squared distances (infinite where there is none) the chances exp(-away * b) over their sum, b by
    bisection such that their entropy is the perplexity's logarithm; even chances where fewer are finite."""
    away = away - away.min(1, keepdims=True)
    b, low, high = np.ones(len(away)), np.zeros(len(away)), np.full(len(away), np.inf)
    for _ in range(64):
        p = np.exp(-away * b[:, None])
        p /= p.sum(1, keepdims=True)
        wide = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0).sum(1) > np.log(perplexity)
        low, high = np.where(wide, b, low), np.where(wide, high, b)
        b = np.where(np.isinf(high), np.minimum(2 * b, 1e12), np.maximum((low + high) / 2, 1e-12))
    return p


def edges(near: DataFrame, perplexity: float) -> DataFrame:
    """(a, b, weight): how strongly two points pull each other, the same from either side."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            size = frame["other"].map(len).to_numpy()
            away = np.full((len(frame), size.max()), np.inf)
            given = np.arange(size.max()) < size[:, None]
            away[given] = 2 - 2 * np.concatenate(frame["score"].to_list())
            yield pd.DataFrame({"a": np.repeat(frame["point"].to_numpy(), size), "b": np.concatenate(frame["other"].to_list()), "weight": chances(away, perplexity)[given] / 2})

    lists = near.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("near"))
    one = lists.select("point", F.col("near.other").alias("other"), F.col("near.score").alias("score")).mapInPandas(run, "a bigint, b bigint, weight double")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def first_places(found: DataFrame, sample: int = 4096) -> DataFrame:
    """(point, x, y, vx, vy): principal components, found on a sample by hash, in units of their spread; no speed."""
    some = found.orderBy(F.xxhash64("point"), "point").limit(sample).toArrow().column("vec").to_pylist()  # cut in a task
    if not some:
        return found.sparkSession.createDataFrame([], PLACE)
    dim = int(pd.Series(some).map(len).mode()[0])
    x = np.stack([v for v in some if len(v) == dim])
    middle = x.mean(0)
    turn = np.zeros((2, dim))
    own = np.linalg.svd(x - middle, full_matrices=False)[2][:2]
    turn[: len(own)] = own
    spread = float(((x - middle) @ turn.T).std()) or 1.0
    at = lambda d: (dot(F.col("vec"), F.array(*map(F.lit, d.tolist()))) - float(d @ middle)) / spread
    still = F.lit(0.0)
    return found.filter(F.size("vec") == dim).select("point", at(turn[0]).alias("x"), at(turn[1]).alias("y"), still.alias("vx"), still.alias("vy"))


def _whole(force: Column) -> Column:
    return F.sum(F.round(force * UNIT).cast("bigint"))


def moved(places: DataFrame, pull: DataFrame, number: int, sample: int, seed: int, rate: float, keep: float, reach: float) -> DataFrame:
    """The places after one round: pulled along edges, pushed away from a sample of all places."""
    drawn = places.orderBy(F.xxhash64("point", F.lit(seed), F.lit(number)), "point").limit(sample).select("x", "y").collect()
    sx, sy = (np.array([float(r[i]) for r in drawn]) for i in (0, 1))
    mean = float((1 / (1 + (sx[:, None] - sx) ** 2 + (sy[:, None] - sy) ** 2)).mean()) if drawn else 1.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, y, vx, vy = (frame[c].to_numpy() for c in ("x", "y", "vx", "vy"))
            dx, dy = x[:, None] - sx, y[:, None] - sy
            near = (1 / (1 + dx * dx + dy * dy)) ** 2 / (len(sx) * mean)
            vx = keep * vx + rate * ((near * dx).sum(1) - frame["px"].to_numpy() / UNIT)
            vy = keep * vy + rate * ((near * dy).sum(1) - frame["py"].to_numpy() / UNIT)
            short = np.minimum(1.0, reach / np.maximum(np.hypot(vx, vy), 1e-12))
            yield pd.DataFrame({"point": frame["point"], "x": x + vx * short, "y": y + vy * short, "vx": vx * short, "vy": vy * short})

    ends = pull.join(places.select(F.col("point").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), "b")
    met = places.join(ends, F.col("point") == F.col("a"), "left")
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    force = F.col("weight") / (1 + dx * dx + dy * dy)
    # Grouped by what is already together: no further exchange, and a hub's edges are added up where they are.
    sums = met.groupBy("point", "x", "y", "vx", "vy").agg(F.coalesce(_whole(force * dx), F.lit(0)).alias("px"), F.coalesce(_whole(force * dy), F.lit(0)).alias("py"))
    return sums.mapInPandas(run, PLACE)


def plane(index: DataFrame, key: str = "row_id", neighbours: int = 15, perplexity: float = 5.0, rounds: int = 40, sample: int = 512, seed: int = 0, rate: float = 1.0, keep: float = 0.8, reach: float = 5.0) -> DataFrame:
    """(key, x, y) of index (key, vec, …), written in the shared folder.

    A round adds `rate` times the force to `keep` times the last move, `reach` at most; pushes come from `sample` places.
    """
    with shuffles_removed(index.sparkSession):
        found, members = points(index, key)
        near = stash(nearest(found, neighbours), "nearest")
        pull = stash(edges(near, perplexity), "edges")
        drop_stash(near)
        places = stash(first_places(found), "places")
        for number in range(rounds):
            before, places = places, stash(moved(places, pull, number, sample, seed, rate, keep, reach), "places")
            drop_stash(before)
        out = stash(members.join(places.select("point", "x", "y"), "point").select(key, "x", "y"), "plane")
        drop_stash(found, members, pull, places)
    return out


def trustworthiness(vectors: np.ndarray, xy: np.ndarray, k: int = 12) -> float:
    """How far the k nearest in the plane are among the nearest in space, 1 at best; for tables that fit in one piece."""
    n = len(vectors)

    def away(x: np.ndarray) -> np.ndarray:
        own = (x**2).sum(1)
        out = own[:, None] + own - 2 * x @ x.T
        np.fill_diagonal(out, np.inf)
        return out

    rank = away(vectors).argsort(1, kind="stable").argsort(1, kind="stable") + 1
    near = away(xy).argsort(1, kind="stable")[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * float(np.maximum(0, np.take_along_axis(rank, near, 1) - k).sum())
