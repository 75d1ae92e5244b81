"""Exact top-k search by inner product: a Voronoi kNN join.

Queries and data are grouped by the nearest of some pivots. From summaries of the query groups (the largest distance of
a query to its pivot, and the range of (query - pivot) · pivot' for every pivot') follow bounds of any score in a group:
with x in the cell of pivot c', for every query q of pivot c,

    c·x + low(c, c') - radius(c) |x - c'|  <=  q·x  <=  c·x + high(c, c') + radius(c) |x - c'|

The (k + 1)-th largest lower bound over all rows is a score that every query of the group reaches k times without its own
row, so a row is sent to just the groups where its upper bound is at least that. There blocks of queries meet blocks
of rows as exact integer products, and a task keeps the k best of each query over all blocks it meets. Where there are fewer
groups than tasks, a group's rows and queries are cut into slices that meet as a grid; both sides are shuffled, neither is
broadcast. Ties are sent as well, so the result is exact whatever the pivots are; they are fitted on at most `sample` rows, and at most `most_pivots` of them and of their squared summaries are known to the driver.
Rows travel packed, 2 bytes a number where that holds them. A hot group is two sides of an equi-join on its pivot, whose
large partitions Spark splits (skew join); no block holds more than ROWS rows or QUERIES queries.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors end in zeros. A
row without id is a candidate, behind all others of its score, and no query unless the caller's condition says so. Of
rows that repeat an id each is a row of its own: a query leaves out its own row only, and each row is a query where the
condition holds. Equal scores are ordered by id, then rows of one id count as equal. An empty table, and a table
without queries, gives no rows. Other columns, whatever their names, take no part. Components of 2^27 or more, and scores
that may leave 64 bits, are errors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import give_back, stash, with_workers
from docspark.llm.vectors import as_doubles, packed, products, unpacked, whole_numbers, width_of

ROWS, QUERIES = 1024, 256
BLOCK = "grp int, rno binary, ids binary, known binary, vectors binary"


def _block(grp: int, rno: np.ndarray, ids: np.ndarray, known: np.ndarray, vectors: np.ndarray) -> dict:
    return {"grp": grp, "rno": rno.tobytes(), "ids": ids.tobytes(), "known": known.tobytes(), "vectors": packed(vectors)}


def _parts(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["rno"], np.int64), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), unpacked(row["vectors"], width)


def _batches(rows: list[dict], like: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], t) for c, t in like.items()})


ARROW = {"grp": pa.int32(), "rno": pa.binary(), "ids": pa.binary(), "known": pa.binary(), "vectors": pa.binary()}


class Packer:
    """Rows of many groups into blocks of at most `rows` rows of one; all blocks together hold at most `held` rows."""

    def __init__(self, rows: int, held: int = 64 * ROWS):
        self.rows, self.held, self.n, self.open = rows, held, 0, defaultdict(list)

    def add(self, grp: int, *columns: np.ndarray) -> Iterator[dict]:
        self.open[grp].append(columns)
        self.n += len(columns[0])
        if sum(len(c[0]) for c in self.open[grp]) >= self.rows:
            yield from self.close(grp)
        if self.n > self.held:
            yield from self.rest()

    def close(self, grp: int) -> Iterator[dict]:
        columns = [np.concatenate(c) for c in zip(*self.open.pop(grp), strict=True)]
        self.n -= len(columns[0])
        for at in range(0, len(columns[0]), self.rows):
            yield _block(grp, *(c[at : at + self.rows] for c in columns))

    def rest(self) -> Iterator[dict]:
        for grp in list(self.open):
            yield from self.close(grp)


def _blocks(df: DataFrame, scale: int, width: int) -> DataFrame:
    """(rno, id, asked, vec) to blocks of whole numbers, queries as group 1 and other rows as group 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(ROWS)
        for batch in batches:
            took, vectors = whole_numbers(batch.column("vec"), scale, width)
            ids = batch.column("id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)[took]
            ids, rno = ids.fill_null(0).to_numpy()[took], batch.column("rno").to_numpy()[took]
            asked = batch.column("asked").to_numpy(zero_copy_only=False).astype(bool)[took]
            for grp in (0, 1):
                mine = asked == bool(grp)
                if mine.any():
                    done = list(packer.add(grp, rno[mine], ids[mine], known[mine], vectors[mine]))
                    if done:
                        yield _batches(done, ARROW)
        if done := list(packer.rest()):
            yield _batches(done, ARROW)
        give_back()

    return df.mapInArrow(run, BLOCK)


def fit_pivots(sample: np.ndarray, m: int, rounds: int = 8) -> np.ndarray:
    """m pivots of a sample in a fixed order: a few Lloyd rounds from its first rows."""
    x = np.unique(sample, axis=0).astype(np.float64)
    x = x[np.random.default_rng(7).permutation(len(x))]
    centres = x[:m].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)[0]
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's cell, its distance to the cell's pivot, and its products with all pivots."""
    dots = x @ centres.T
    near = np.argmin((centres * centres).sum(1) - 2 * dots, axis=1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(1)), dots


def _grouped(asked: DataFrame, pivots: np.ndarray, width: int) -> tuple[DataFrame, DataFrame]:
    """Queries as single rows with their group, and (grp, pos, radius, low, high): what is known of a group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rno, ids, known, vectors = _parts(row, width)
                near, _, _ = _nearest(vectors.astype(np.float64), pivots)
                yield _batches([_block(int(g), rno[i : i + 1], ids[i : i + 1], known[i : i + 1], vectors[i : i + 1]) for i, g in enumerate(near)], ARROW)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(pivots)
        for batch in batches:
            for row in batch.to_pylist():
                found, radius, low, high = summarised(_parts(row, width)[3].astype(np.float64), pivots)
                yield pa.RecordBatch.from_pydict({"grp": np.repeat(found, m).astype(np.int32), "pos": np.tile(np.arange(m, dtype=np.int32), len(found)), "radius": np.repeat(radius, m), "low": low.ravel(), "high": high.ravel()})

    known = asked.mapInArrow(summaries, "grp int, pos int, radius double, low double, high double").groupBy("grp", "pos").agg(F.max("radius").alias("radius"), F.min("low").alias("low"), F.max("high").alias("high"))
    return asked.mapInArrow(rows, BLOCK), known


def _regrouped(rows: DataFrame, width: int, slices: int) -> DataFrame:
    """Rows of a group into blocks of QUERIES, by that many tasks a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(QUERIES)
        for batch in batches:
            for row in batch.to_pylist():
                if done := list(packer.add(row["grp"], *_parts(row, width))):
                    yield _batches(done, ARROW)
        if done := list(packer.rest()):
            yield _batches(done, ARROW)

    return rows.repartition("grp", F.pmod(F.xxhash64("rno"), F.lit(slices))).mapInArrow(run, BLOCK)


def summarised(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(groups that have a query, radius, low, high) of queries."""
    m = len(pivots)
    near, away, dots = _nearest(x, pivots)
    radius, low, high = np.full(m, -1.0), np.full((m, m), np.inf), np.full((m, m), -np.inf)
    over = dots - (pivots @ pivots.T)[near]
    np.maximum.at(radius, near, away)
    np.minimum.at(low, near, over)
    np.maximum.at(high, near, over)
    found = np.flatnonzero(radius >= 0)
    return found, radius[found], low[found], high[found]


class Bounds:
    """Of any score between a row and the queries of each group that has any."""

    def __init__(self, pivots: np.ndarray, groups: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.groups, self.radius, self.low, self.high = pivots, groups, radius, low, high

    @classmethod
    def gathered(cls, pivots: np.ndarray, summaries: list) -> Bounds:
        groups = np.array(sorted({r.grp for r in summaries}), np.int64)
        at, shape = {int(g): k for k, g in enumerate(groups)}, (len(groups), len(pivots))
        out = cls(pivots, groups, np.zeros(len(groups)), np.zeros(shape), np.zeros(shape))
        for r in summaries:
            k = at[r.grp]
            out.radius[k], out.low[k, r.pos], out.high[k, r.pos] = r.radius, r.low, r.high
        return out

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper), rows by groups, with room for what floating point rounds away."""
        near, away, dots = _nearest(x, self.pivots)
        base, span = dots[:, self.groups], away[:, None] * self.radius
        room = 1e-9 * (1 + np.abs(base) + span + np.abs(self.low[:, near].T) + np.abs(self.high[:, near].T) + np.abs(dots).max(1, initial=0)[:, None])
        return base + self.low[:, near].T - span - room, base + self.high[:, near].T + span + room


def choose_pivots(sample: np.ndarray, k: int, queries: int, most: int) -> np.ndarray:
    """Pivots in the number of which rows move and meet queries at the least cost, as far as the sample tells.

    More groups tell rows and queries apart more finely, but a row goes to each group that may need it. Where vectors
    have no structure every group needs every row, and few groups are best. To move a row costs about as much as 16 products.
    """
    x, best, m = sample.astype(np.float64), None, 1
    while m <= max(1, min(most, queries, len(sample))):
        pivots = fit_pivots(sample, m)
        bounds = Bounds(pivots, *summarised(x, pivots))
        lower, upper = bounds.of(x)
        needed = (upper >= -np.sort(-lower, axis=0)[min(k, len(x) - 1)]).mean(0)
        asked = np.bincount(_nearest(x, pivots)[0], minlength=m)[bounds.groups] / len(x)
        cost = 16 * needed.sum() + queries * (needed * asked).sum()
        if best is None or cost < best[0]:
            best = cost, pivots
        m *= 4
    return best[1]


def _reached(blocks: DataFrame, bounds: Bounds, k: int, width: int) -> dict[int, float]:
    """For each group a score that all its queries reach k times without their own row; absent where rows are too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((k + 1, len(bounds.groups)), -np.inf)
        for batch in batches:
            for row in batch.to_pylist():
                lower, _ = bounds.of(_parts(row, width)[3].astype(np.float64))
                best = -np.sort(-np.concatenate([best, lower]), axis=0)[: k + 1]
        where = np.isfinite(best)
        grp = np.broadcast_to(bounds.groups.astype(np.int32), best.shape)
        yield pa.RecordBatch.from_pydict({"grp": grp[where], "lower": best[where]})

    order = Window.partitionBy("grp").orderBy(F.desc("lower"))
    kth = blocks.select("vectors", "rno", "ids", "known").mapInArrow(run, "grp int, lower double").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).filter(F.col("n") == k + 1)
    return {r.grp: r.lower for r in kth.collect()}


def _sent(blocks: DataFrame, bounds: Bounds, reached: np.ndarray, width: int) -> DataFrame:
    """Blocks of rows for each group that may need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(ROWS)
        for batch in batches:
            for row in batch.to_pylist():
                columns = _parts(row, width)
                needed = bounds.of(columns[3].astype(np.float64))[1] >= reached
                for g in np.flatnonzero(needed.any(0)):
                    if done := list(packer.add(int(bounds.groups[g]), *(c[needed[:, g]] for c in columns))):
                        yield _batches(done, ARROW)
        if done := list(packer.rest()):
            yield _batches(done, ARROW)
        give_back()

    return blocks.mapInArrow(run, BLOCK)


#: Hits that a task keeps at most of the queries it has met; beyond that it hands them on and begins anew.
HELD_HITS = 1 << 20


def _scores(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """rows @ wanted.T, exact: in single precision where its 24 bits hold every sum."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(wanted).max(initial=0)) * rows.shape[1]
    return rows.astype(np.float32) @ wanted.T.astype(np.float32) if most < 1 << 24 else products(rows, wanted)


class Best:
    """The k best rows so far of each query of one block."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int):
        self.qno, self.qids, self.qknown, self.k = queries, ids, known, k
        self.least = np.full(len(queries), np.iinfo(np.int64).min)
        self.hits = [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64)]  # query, score, known, id, rno

    def __len__(self) -> int:
        return len(self.hits[0])

    def add(self, scores: np.ndarray, rno: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        least = self.least
        if (least == np.iinfo(np.int64).min).any() and len(rno) > self.k:  # own row aside, the k best of this block are as good
            least = np.maximum(least, np.partition(scores, len(rno) - self.k - 1, axis=0)[len(rno) - self.k - 1].astype(np.int64))
        if scores.dtype == np.float32:
            least = np.maximum(least, -(1 << 24)).astype(np.float32)
        at, query = np.nonzero(scores >= least)
        own = rno[at] == self.qno[query]
        at, query = at[~own], query[~own]
        if not len(at):
            return
        new = (query, scores[at, query].astype(np.int64), known[at], ids[at], rno[at])
        query, score, known, ids, rno = (np.concatenate(x) for x in zip(self.hits, new, strict=True))
        order = np.lexsort((rno, ids, ~known, -score, query))
        query = query[order]
        begin = np.searchsorted(query, query)
        keep = np.arange(len(query)) - begin < self.k
        order = order[keep]
        self.hits = [query[keep], score[order], known[order], ids[order], rno[order]]
        query, score = self.hits[:2]
        last = np.arange(len(query)) - np.searchsorted(query, query) == self.k - 1
        self.least[query[last]] = score[last]

    def batch(self) -> pa.RecordBatch:
        query, score, known, ids, rno = self.hits
        return pa.RecordBatch.from_pydict({"qno": self.qno[query], "query_id": pa.array(self.qids[query], mask=~self.qknown[query]), "rno": rno, "vec_id": pa.array(ids, mask=~known), "score": score})


def _solved(met: DataFrame, k: int, width: int) -> DataFrame:
    """(qno, query_id, rno, vec_id, score): of the blocks of rows that a task meets the k best for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, Best] = {}
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                rno, ids, known, vectors = _parts(row, width)
                qno, qids, qknown, wanted = _parts({c: row[f"q_{c}"] for c in ("rno", "ids", "known", "vectors")}, width)
                mine = best.setdefault(row["q_rno"], Best(qno, qids, qknown, k))
                held -= len(mine)
                mine.add(_scores(vectors, wanted), rno, ids, known)
                held += len(mine)
                if held > HELD_HITS:
                    yield from (b.batch() for b in best.values())
                    best, held = {}, 0
        yield from (b.batch() for b in best.values())
        give_back()

    return met.mapInArrow(run, "qno bigint, query_id bigint, rno bigint, vec_id bigint, score bigint")


def grid(tasks: int, groups: int, queries: int, rows: int) -> tuple[int, int]:
    """(slices of rows, slices of queries) of a group: as many pairs of slices as fill all tasks, at the least that is
    moved, since each slice of rows goes to all slices of queries and the other way round."""
    cells = max(1, -(-tasks // groups))
    of_queries = min(range(1, cells + 1), key=lambda c: rows * c + queries * -(-cells // c))
    return -(-cells // of_queries), of_queries


def knn_join(vectors: DataFrame, asks: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vec: str = "embedding", sample: int = 4096, most_pivots: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `asks` holds, the k other rows of the highest inner product.

    Components count as floor(scale * x). sample bounds the rows that pivots are fitted on; there are at most most_pivots,
    as many as make the search cheapest on the sample.
    """
    with_workers(vectors.sparkSession)
    rows = vectors.select(F.monotonically_increasing_id().alias("rno"), F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.coalesce(asks, F.lit(False)).alias("asked"), as_doubles(vec).alias("vec"))
    width = width_of(vectors, vec)
    if not width:
        width = 1
    held = stash(_blocks(rows, scale, width), "vectors")
    counted = {r.grp: r.n for r in held.groupBy("grp").agg(F.sum(F.octet_length("known")).alias("n")).collect()}
    if not counted.get(1):
        return held.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    fitted_on = max(1, min(sample, (1 << 23) // width))
    chosen = rows.filter("vec is not null").select("vec").orderBy(F.xxhash64("id", "vec")).limit(fitted_on).toArrow().column("vec").combine_chunks()
    _, some = whole_numbers(chosen, scale, width)
    pivots = choose_pivots(some, k, counted[1], most_pivots)
    queries, known = _grouped(held.filter("grp = 1"), pivots, width)
    bounds = Bounds.gathered(pivots, known.collect())  # at most most_pivots squared rows
    least = _reached(held, bounds, k, width)
    reached = np.array([least.get(int(g), -np.inf) for g in bounds.groups])
    asked = _regrouped(queries, width, max(1, counted[1] // (16 * QUERIES))).select(F.col("grp"), *(F.col(c).alias(f"q_{c}") for c in ("rno", "ids", "known", "vectors")))
    down, across = grid(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(bounds.groups), counted[1], sum(counted.values()))
    cell = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = _sent(held, bounds, reached, width).withColumn("down", cell("rno", down)).withColumn("across", every(across))
    asked = asked.withColumn("across", cell("q_rno", across)).withColumn("down", every(down))
    # Never a broadcast: queries grow with the table, and their copies with the slices, whatever they shrink to when packed.
    near = _solved(sent.join(asked.hint("merge"), ["grp", "down", "across"]).drop("grp", "down", "across"), k, width)
    order = Window.partitionBy("qno").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "rno")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
