"""A clustered index: exact top-k for a batch of queries that leaves out what can't be among the best.

Rows lie in lists, each with a centre and the largest distance from it. A list's centre and radius bound the score of any
of its rows: a query visits the FIRST lists of the highest bounds, and then those others whose bound reaches its k-th
score so far. Lists are dealt to slices of about SLICE rows, and queries to parts of about PART; a slice meets a part in
one task, as single-precision products with room for their error, and only pairs that may reach the query's k-th score
are finished in double precision. A slice travels once for each part and a query once for each slice that it needs, so
no query is ever copied for each list. Centres are fitted on a bounded sample; every row is in the index, and they don't
change a result, only what it costs. Vectors without structure (equally long in all directions) are bounded by nothing:
then all lists are visited, every slice meets every part, and the work grows with rows times queries.

Defined cases: rows and queries without a vector, or with a null or non-finite component, take no part; index vectors
count as they are, queries over their lengths; those of another dimension than the index's are left out; scores count
to 12 decimals, ties by key. Keys are whole numbers and, for queries, distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.retrieval import ROW_BLOCK
from docspark.plans import shared

#: Lists that a query visits before it has a k-th score.
FIRST = 4
#: Rows of a slice, queries of a part, and queries of a block within it.
SLICE, PART, QUERIES = 65536, 16384, 1024
#: Scores count to so many decimals; bounds have this much room.
DECIMALS, ROOM = 12, 1e-9


@dataclass
class Clustered:
    """An index: blocks (list_no, keys, matrix) as a table, its lists' centres, radii and sizes, and their dimension."""

    blocks: DataFrame | None
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def known(self) -> Clustered:
        """What tasks get of it: all but the table."""
        return replace(self, blocks=None)

    def slices(self) -> tuple[np.ndarray, np.ndarray]:
        """(first slice, number of slices) of each list: small lists share one, long ones have several."""
        begin, parts, at, n = np.zeros(len(self.rows), np.int64), np.maximum(1, -(-self.rows // SLICE)), 0, 0
        for no, size in enumerate(self.rows.tolist()):
            if n and n + size > SLICE:
                at, n = at + 1, 0
            begin[no], n = at, n + size
            if parts[no] > 1:
                at, n = at + int(parts[no]), 0
        return begin, parts

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What no score of a list exceeds, queries by lists."""
        return np.where(self.rows > 0, q @ self.centres.T + np.linalg.norm(q, axis=1, keepdims=True) * self.radius + ROOM, -np.inf)


def _finite(vec: str = "vec") -> Column:
    return F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _fitted(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centres by a few Lloyd rounds from the sample's first rows."""
    centres = x[:lists].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        n, sums = np.bincount(near, minlength=len(centres)), np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def build(index: DataFrame, key: str = "row_id", lists: int | None = None, sample: int = 4096) -> Clustered | None:
    """The clustered index of (key, vec), in the shared folder; None without vectors. There are at most `lists` lists, or
    else one for each 256 rows, up to 256; they are fitted on at most `sample` rows."""
    rows = index.filter(_finite()).select(F.col(key).cast("bigint").alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    # As Arrow batches the sample is cut in a task; collected as rows, the driver would get one of that size from each task.
    some = rows.orderBy(F.xxhash64("key")).limit(sample).toArrow().column("vec").to_pylist()
    if not some:
        return None
    if lists is None:
        lists = max(1, min(256, rows.count() // 256))
    dim = int(pd.Series(some).map(len).mode()[0])
    centres = _fitted(np.stack([v for v in some if len(v) == dim]), lists)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(no: int) -> pd.DataFrame:
            keys, x, away = zip(*held.pop(no), strict=True)
            return pd.DataFrame({"list_no": [no], "n": [len(keys)], "away": [max(away)], "keys": [np.array(keys, np.int64).tobytes()], "matrix": [np.stack(x).tobytes()]})

        for frame in frames:
            frame = frame[frame["vec"].map(len) == dim]
            if not len(frame):
                continue
            x = np.stack(frame["vec"].to_list())
            near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
            away = np.linalg.norm(x - centres[near], axis=1)
            for no, k, v, a in zip(near.tolist(), frame["key"].tolist(), x, away.tolist(), strict=True):
                held.setdefault(no, []).append((k, v, a))
                if len(held[no]) == ROW_BLOCK:
                    yield block(no)
        for no in list(held):
            yield block(no)

    blocks = shared.stash(rows.mapInPandas(run, "list_no int, n int, away double, keys binary, matrix binary"), "clustered")
    radius, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in blocks.groupBy("list_no").agg(F.max("away").alias("away"), F.sum("n").alias("n")).collect():  # a row for each list
        radius[r.list_no], sizes[r.list_no] = r.away, r.n
    return Clustered(blocks, centres, radius, sizes)


def _asked(index: Clustered, queries: DataFrame, query_key: str) -> DataFrame:
    """(query, vec, first): queries over their lengths, and the lists that each visits first."""
    known, dim, first = index.known(), index.dim, min(FIRST, len(index.centres))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[frame["vec"].map(len) == dim]
            if len(frame):
                x = np.stack(frame["vec"].to_list())
                length = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(length == 0, 1, length)
                lists = np.argsort(-known.bounds(x), axis=1, kind="stable")[:, :first].astype(np.int32)
                yield pd.DataFrame({"query": frame["query"], "vec": [v.tobytes() for v in x], "first": [v.tobytes() for v in lists]})

    return queries.filter(_finite()).select(F.col(query_key).cast("bigint").alias("query"), F.col("vec").cast("array<double>").alias("vec")).mapInPandas(run, "query bigint, vec binary, first binary")


def _visits(index: Clustered, asked: DataFrame, parts: int, begun: bool) -> DataFrame:
    """(slice, part, query, vec, first, kth): queries in each slice that they need, at first or after that."""
    known, (begin, number) = index.known(), index.slices()
    lists = np.arange(len(begin))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), QUERIES):
                some = frame[at : at + QUERIES]
                q, first = np.stack([np.frombuffer(v) for v in some["vec"]]), np.stack([np.frombuffer(v, np.int32) for v in some["first"]])
                needed = (first[:, :, None] == lists).any(1)
                if begun:
                    needed = ~needed & (known.bounds(q) >= np.maximum(some["kth"].to_numpy()[:, None], -1e300))
                row, no = np.nonzero(needed)
                n = number[no]
                which = np.repeat(begin[no] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else no
                pairs = np.unique(np.stack([np.repeat(row, n), which], 1), axis=0)
                yield some.iloc[pairs[:, 0]].assign(slice=pairs[:, 1].astype(np.int32))[["slice", "query", "vec", "first", "kth"]]

    made = asked.mapInPandas(run, "slice int, query bigint, vec binary, first binary, kth double")
    return made.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))


class Hits:
    """The k best rows so far of each of some queries."""

    def __init__(self, q: np.ndarray, kth: np.ndarray, k: int):
        self.q, self.least, self.k = q, kth.copy(), k
        self.single = q.astype(np.float32)
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]  # query, score, key
        self.n = self.kept = 0

    def add(self, mine: np.ndarray, keys: np.ndarray, x: np.ndarray, single: np.ndarray, longest: float) -> int:
        """Takes a block's rows for the queries `mine`; how many pairs were finished."""
        scores = self.single[mine] @ single.T
        # The most that rounding to single precision and adding up can take from a score of unit queries or add to it, twice over.
        room = (x.shape[1] + 8) * 2.0**-22 * (1 + longest)
        least = self.least[mine]
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and len(keys) >= self.k:
            least[new] = np.partition(scores[new], len(keys) - self.k, axis=1)[:, len(keys) - self.k] - room
        query, row = np.nonzero(scores >= np.maximum(least - room, -3e38)[:, None].astype(np.float32))
        if not len(row):
            return 0
        query = mine[query]
        self.held.append((query, np.round(np.einsum("ij,ij->i", x[row], self.q[query]), DECIMALS), keys[row]))
        self.n += len(row)
        if self.n > 2 * self.kept + 4 * QUERIES:
            self.trim()
        return len(row)

    def trim(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score, key = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((key, -score, query))
        query, score, key = query[order], score[order], key[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep, last = place < self.k, place == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        self.held = [(query[keep], score[keep], key[keep])]
        self.n = self.kept = int(keep.sum())
        return self.held[0]


def _scored(index: Clustered, visits: DataFrame, k: int, parts: int, begun: bool) -> DataFrame:
    """(query, key, score, finished, met): hits of the visits; a row without key counts what its task has met and finished."""
    known, dim, (begin, number) = index.known(), index.dim, index.slices()
    kind = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("score", pa.float64()), ("finished", pa.int64()), ("met", pa.int64())])

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return kind.empty_table()
        blocks = [(no, np.frombuffer(keys, np.int64), np.frombuffer(x).reshape(-1, dim)) for no, keys, x in zip(*(rows.column(c).to_pylist() for c in ("list_no", "keys", "matrix")), strict=True)]
        blocks = [(no, keys, x, x.astype(np.float32), float(np.sqrt((x * x).sum(1).max()))) for no, keys, x in blocks]
        query, kth = (asked.column(c).to_numpy() for c in ("query", "kth"))
        q = np.frombuffer(b"".join(asked.column("vec").to_pylist())).reshape(-1, dim)
        first = np.frombuffer(b"".join(asked.column("first").to_pylist()), np.int32).reshape(len(q), -1)
        order = np.lexsort((query, first[:, 0]))
        found, finished, met = [], 0, 0
        for at in range(0, len(order), QUERIES):
            own = order[at : at + QUERIES]
            hits, bound = Hits(q[own], kth[own], k), known.bounds(q[own])
            for no, keys, x, single, longest in blocks:
                early = (first[own] == no).any(1)
                mine = np.flatnonzero(~early & (bound[:, no] >= hits.least) if begun else early)
                if len(mine):
                    met += len(mine) * len(keys)
                    finished += hits.add(mine, keys, x, single, longest)
            of, score, key = hits.trim()
            found.append((query[own][of], key, score))
        of, key, score = (np.concatenate(c) for c in zip(*found, strict=True))
        none = np.zeros(len(of), np.int64)
        hits = pa.Table.from_pydict({"query": of, "key": key, "score": score, "finished": none, "met": none}, kind)
        return pa.concat_tables([hits, pa.Table.from_pydict({"query": [None], "key": [None], "score": [None], "finished": [finished], "met": [met]}, kind)])

    at = lambda x: F.get(F.array(*map(F.lit, x.tolist())), F.col("list_no"))
    dealt = index.blocks.select((at(begin) + F.pmod(F.xxhash64("keys"), at(number))).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "list_no", "keys", "matrix")
    return dealt.groupBy("slice", "part").cogroup(visits.groupBy("slice", "part")).applyInArrow(cell, "query bigint, key bigint, score double, finished bigint, met bigint")


def top_k(index: Clustered | None, queries: DataFrame, k: int, key: str = "row_id", query_key: str = "query_id") -> tuple[DataFrame, dict[str, int]]:
    """((query_key, rank, key, score), work): for each query its k best rows, ties by key, as retrieval.top_k_batch gives
    them. work counts pairs of a query and a row: `all`, those in visited lists (`met`), and those scored to the end (`finished`)."""
    spark, work = queries.sparkSession, {"all": 0, "met": 0, "finished": 0}
    if index is None:
        return spark.createDataFrame([], f"{query_key} bigint, rank int, {key} bigint, score double"), work
    asked = shared.stash(_asked(index, queries, query_key), "asked")
    n = asked.count()
    work["all"] = n * int(index.rows.sum())
    parts = max(1, -(-n // PART))
    ranks = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    best = None
    for begun in (False, True):
        if best is None:
            open_ = asked.withColumn("kth", F.lit(float("-inf")))
        else:
            kth = best.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("kth"))
            open_ = asked.join(kth, "query", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
        scored = shared.stash(_scored(index, _visits(index, open_, parts, begun), k, parts, begun), "scored")
        done = scored.agg(F.sum("finished").alias("finished"), F.sum("met").alias("met")).first()
        work["finished"] += done.finished or 0
        work["met"] += done.met or 0
        found = scored.filter("key is not null").select("query", "key", "score")
        every = found if best is None else best.select("query", "key", "score").unionByName(found)
        before, best = best, shared.stash(every.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k), "best")
        shared.drop_stash(scored, *([before] if begun else []))
    shared.drop_stash(asked)
    return best.select(F.col("query").alias(query_key), "rank", F.col("key").alias(key), "score"), work
