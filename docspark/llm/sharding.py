"""Sharding by an exact communication matrix.

The source partitions' row counts are fixed first. A matrix of partition-to-shard counts is drawn from the
multivariate hypergeometric law, so that each shard gets its exact size and the matrix has the law a uniform
permutation would give it. Each partition is permuted locally (a sort by a random key) and cut at its row of the
matrix; rows are exchanged by shard and a second random key, range-partitioned so that no shard is one task; the
order there is the second permutation, numbered gapless from per-task counts. Together: a uniform shuffle.

The driver sees one count for each partition (at most max_partitions) and for each pair of task and shard. Rows are
written to the shared folder before they are counted, so a lost executor cannot change what was counted.

Defined cases: nulls are values like any other, so is a null text, which has no bytes; an empty table gives an empty
result; repeated rows and rows that tie are rows of their own; rows of any length are moved whole; extra columns pass
through, whatever their names, but for shard and slot, which the result replaces.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import drop_stash, stash, whole

LOCAL = (1 << 33) - 1  # the low bits of monotonically_increasing_id: the place in the partition


def draw_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """How many rows each partition gives to each shard; shard sizes are at most one apart."""
    total = sum(counts)
    left = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], np.int64)
    rng, out = np.random.default_rng(seed), np.zeros((len(counts), n_shards), np.int64)
    for p, n in enumerate(counts):
        at_hand = int(left.sum())
        for s in range(n_shards):  # marginal by marginal; numpy's sampler takes less than 10^9 of either kind
            rest = at_hand - int(left[s])
            n_left = n - int(out[p].sum())
            if n_left <= 0:
                break
            if rest <= 0:
                out[p, s] = n_left
            elif at_hand < 10**9:
                out[p, s] = rng.hypergeometric(int(left[s]), rest, n_left)
            else:
                out[p, s] = _large_draw(rng, int(left[s]), rest, n_left)
            at_hand = rest
        left -= out[p]
    return out


def _large_draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """An exact hypergeometric draw of any size: binomials of the same rate, taken when they add up to n."""
    rate = n / (good + bad)
    while True:
        x = rng.binomial(good, rate, 4096)
        hit = np.flatnonzero(x + rng.binomial(bad, rate, 4096) == n)
        if len(hit):
            return int(x[hit[0]])


def _inline(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table of driver values as one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 7, max_partitions: int = 8192) -> DataFrame:
    """df's columns with shard (0 to n_shards - 1) and slot (its place there, gapless from 0), in place of any so named.

    The matrix is broadcast: at most max_partitions rows of n_shards counts.
    """
    spark, names = df.sparkSession, [c for c in df.columns if c not in ("shard", "slot")]
    few = df.select(whole(df.select(*(F.col(f"`{c}`") for c in names)))).coalesce(max_partitions)
    local = stash(few.withColumn("key", F.rand(seed)).sortWithinPartitions("key").select("whole", F.monotonically_increasing_id().alias("id")), "permuted")
    part, place = F.shiftright("id", 33).cast("int"), F.col("id").bitwiseAND(F.lit(LOCAL))
    counts = sorted((r["p"], r["n"]) for r in local.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    matrix = draw_matrix([n for _, n in counts], n_shards, seed)
    cuts = _inline(spark, [{"p": p, "cut": np.cumsum(row)[:-1].tolist()} for (p, _), row in zip(counts, matrix, strict=True)], "p int, cut array<bigint>")
    dealt = local.join(F.broadcast(cuts), part == F.col("p")).select("whole", F.size(F.filter("cut", lambda c: c <= place)).alias("shard"), F.rand(seed + 1).alias("key"))
    again = stash(dealt.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key").select("whole", "shard", F.monotonically_increasing_id().alias("id")), "exchanged")
    drop_stash(local)
    runs = sorted((r["shard"], r["p"], r["n"], r["at"]) for r in again.groupBy("shard", part.alias("p")).agg(F.count("*").alias("n"), F.min(place).alias("at")).collect())
    base, seen = [], {}
    for shard, p, n, at in runs:  # the range partitions of a shard follow one another
        base.append({"s": shard, "p": p, "shift": seen.get(shard, 0) - at})
        seen[shard] = seen.get(shard, 0) + n
    shifts = _inline(spark, base, "s int, p int, shift bigint")
    out = again.join(F.broadcast(shifts), (F.col("s") == F.col("shard")) & (F.col("p") == part))
    return out.select(*(F.col(f"whole.`{c}`").alias(c) for c in names), "shard", (place + F.col("shift")).alias("slot"))
