"""Colours of all images clustered together: seeds and Lloyd's rounds as DataFrame steps, no image in one piece anywhere.

Pixels become counts of distinct colours first. A round meets each colour with its image's centres, and the nearest
centre's sums are formed map-side, so that a round moves one row an image and centre; an image that holds most of the
pixels is spread over tasks as any other. Seeds are drawn as k-means++ does, the next with a chance in proportion to its pixels
times its squared distance from the seeds before: the smallest of -ln(u) / (pixels x distance) wins, u from a hash of the
colour, so draws are the same wherever they run.

Rows with a null key or component are left out; an image of fewer colours than `k` gets as many clusters; equal distances go to
the lower cluster, equal draws to the smaller colour; a centre that no colour is nearest to stays where it is. Other columns
aren't read. A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.plans.shared import drop_stash, stash

RGB = ("r", "g", "b")


def _distance(c: Column) -> Column:
    r, g, b = (F.col(x) - c[x] for x in RGB)
    return r * r + g * g + b * b


def _draw(number: int) -> Column:
    """-ln(u) of a colour in one draw, u from 2^-33 to 1."""
    raw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(number), *RGB).cast("binary")), 1, 8), 16, 10).cast("double")
    return -F.log((raw + 0.5) / 4294967296.0)


def _point() -> Column:
    return F.struct(*(F.col(x).cast("double").alias(x) for x in RGB))


def colour_counts(pixels: DataFrame, key: str) -> DataFrame:
    """(key, r, g, b, n) of pixels (key, r, g, b, …)."""
    return pixels.select(key, *(F.col(x).cast("int").alias(x) for x in RGB)).dropna().groupBy(key, *RGB).agg(F.count("*").alias("n"))


def seeds(counts: DataFrame, key: str, k: int) -> DataFrame:
    """(key, centres): up to k distinct colours of each image, drawn one after another."""

    def drawn(df: DataFrame, number: int, chance: Column, name: str) -> DataFrame:
        won = df.groupBy(key).agg(F.min(F.struct((_draw(number) / chance).alias("race"), *RGB)).alias("won"))
        return won.select(key, F.struct(*(F.col(f"won.{x}").cast("double").alias(x) for x in RGB)).alias(name))

    out = drawn(counts, 0, F.col("n"), "first").select(key, F.array("first").alias("centres"))
    for number in range(1, k):
        far = counts.join(out, key).withColumn("far", F.array_min(F.transform("centres", _distance))).filter("far > 0")
        won = drawn(far, number, F.col("n") * F.col("far"), "next")
        out = out.join(won, key, "left").select(key, F.when(F.col("next").isNull(), F.col("centres")).otherwise(F.array_append("centres", F.col("next"))).alias("centres"))
        out = _next(out, None if number == 1 else before)
        before = out
    return out


def _sums(counts: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """(key, cluster, r, g, b, n): each cluster's mean, from the colours that its centre is nearest to."""
    near = F.array_min(F.transform("centres", lambda c, i: F.struct(_distance(c).alias("d"), i.alias("i"))))["i"]
    placed = counts.join(centres, key).select(key, near.alias("cluster"), *RGB, "n")
    sums = placed.groupBy(key, "cluster").agg(*(F.sum(F.col(x) * F.col("n")).alias(x) for x in RGB), F.sum("n").alias("n"))
    return sums.select(key, "cluster", *((F.col(x) / F.col("n")).alias(x) for x in RGB), "n")


def _next(state: DataFrame, before: DataFrame | None) -> DataFrame:
    """The state of a round, written, in place of the one before: lineage stays short, and a state's size is known, so
    that Spark sends a small one to the colours and otherwise shuffles by image."""
    out = stash(state, "centres")
    if before is not None:
        drop_stash(before)
    return out


def lloyd(counts: DataFrame, centres: DataFrame, key: str, rounds: int) -> DataFrame:
    """centres (key, centres) after so many rounds."""
    out = centres
    for number in range(1, rounds + 1):
        means = _sums(counts, out, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cluster", _point()))).alias("means"))  # k entries at most
        out = out.join(means, key).select(key, F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("means", i), c)).alias("centres"))
        out = _next(out, None if number == 1 else before)
        before = out
    return out


def clusters(pixels: DataFrame, key: str, k: int = 5, rounds: int = 20) -> DataFrame:
    """(key, cluster, r, g, b, n) of pixels (key, r, g, b, …): mean colours, cut to whole numbers, and pixels of each cluster."""
    counts = stash(colour_counts(pixels, key), "colours")
    drawn = seeds(counts, key, k)
    out = stash(_sums(counts, lloyd(counts, drawn, key, rounds), key).withColumns({x: F.col(x).cast("int") for x in RGB}), "clusters")
    drop_stash(counts, drawn)
    return out
