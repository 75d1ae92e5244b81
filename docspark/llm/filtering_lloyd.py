"""Vector code compression: product codebooks by Lloyd's rounds with the filtering algorithm.

Vectors are cut into equal parts. Every task packs its rows into blocks and builds a kd-tree over each part of a block: a
node has its bounding box, its number of points and their sum. The trees are written once, and each round reads them: all
nodes of a level are handled at once, an entry is eliminated from a node when no point of its box can be nearer to it
than to the entry nearest the box's middle, and a node with one entry left gives its count and sum to that entry without
a look at its points. Only leaves with several entries left compare points. Tasks return a sum and count for each entry
of each part (parts * entries rows), and the driver holds the codebooks alone. All is whole numbers, so a result hangs
neither on blocks nor on their order.

Defined cases: vectors that are null or hold null or non-finite components are left out; the others end in zeros, up to
the longest one's length, rounded up to a multiple of parts. With fewer rows than entries there are as many entries as
rows; rows that repeat an id all count, and first entries are ordered by id (null last), then by vector. Entries
that no part is nearest to stay; equal distances go to the lower entry. Labels are compared as they are, nulls
together. An empty table gives no rows. Other columns take no part. Components of 2^27 or more are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docspark.llm.common import give_back, sent_whole, stash, with_workers
from docspark.llm.vectors import as_doubles, packed, unpacked, whole_numbers, width_of

#: Rows of a block, and points of a leaf at most.
ROWS, LEAF = 8192, 16


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(order, starts of each level's nodes, points in order): halved at the median of each node's widest side."""
    order, starts = np.arange(len(points)), [np.array([0, len(points)])]
    while np.diff(starts[-1]).max() > leaf:
        at = starts[-1]
        mine = points[order]
        low, high = np.minimum.reduceat(mine, at[:-1]), np.maximum.reduceat(mine, at[:-1])
        node = np.repeat(np.arange(len(at) - 1), np.diff(at))
        side = np.argmax(high - low, axis=1)[node]
        order = order[np.lexsort((mine[np.arange(len(mine)), side], node))]
        halves = np.empty(2 * len(at) - 1, np.int64)
        halves[::2], halves[1::2] = at, (at[:-1] + at[1:]) // 2
        starts.append(halves)
    return order, starts, points[order]


def summed(points: np.ndarray, starts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lower corner, upper corner, sum) of the nodes of each level."""
    return [(np.minimum.reduceat(points, s[:-1]), np.maximum.reduceat(points, s[:-1]), np.add.reduceat(points, s[:-1])) for s in starts]


def nearest(points: np.ndarray, book: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Each point's nearest entry of those allowed (points by entries, one at least), the lower of equal ones."""
    point, entry = np.nonzero(allowed)
    away = ((points[point] - book[entry]) ** 2).sum(1)
    least = np.minimum.reduceat(away, np.searchsorted(point, np.arange(len(points))))
    hit = np.flatnonzero(away == least[point])
    return entry[hit[np.searchsorted(point[hit], np.arange(len(points)))]]


def filtered(starts: list[np.ndarray], nodes: list, points: np.ndarray, book: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(level, nodes, their entries) of nodes that belong to one entry whole; then the points of all other leaves, and their entries."""
    at, live, whole = np.zeros(1, np.int64), np.ones((1, len(book)), bool), []
    for level, (low, high, _) in enumerate(nodes):
        lo, hi = low[at], high[at]
        # Twice the middle against twice the entries: whole numbers.
        middle = ((2 * book - (lo + hi)[:, None, :]) ** 2).sum(2)
        star = np.where(live, middle, np.iinfo(np.int64).max).argmin(1)
        best = book[star]
        toward = book[None, :, :] - best[:, None, :]
        corner = np.where(toward > 0, hi[:, None, :], lo[:, None, :])
        # How much farther the box's most favourable corner is from an entry than from the best one.
        more = (toward * (book[None, :, :] + best[:, None, :] - 2 * corner)).sum(2)
        live &= (more < 0) | ((more == 0) & (np.arange(len(book)) <= star[:, None]))
        live[np.arange(len(at)), star] = True
        one = live.sum(1) == 1
        whole.append((level, at[one], star[one]))
        at, live = at[~one], live[~one]
        if level + 1 < len(nodes):
            at, live = np.stack([2 * at, 2 * at + 1], 1).ravel(), np.repeat(live, 2, 0)
    if not len(at):
        return whole, at, at
    n = starts[-1][at + 1] - starts[-1][at]
    place = np.repeat(starts[-1][at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    return whole, place, nearest(points[place], book, np.repeat(live, n, 0))


def _trees(vectors: DataFrame, scale: int, width: int, parts: int, vec_id: str, vec: str, label: str | None) -> DataFrame:
    """Blocks: (ids, labels, n, trees array<struct<order, starts, points, boxes>>), a tree for each part."""
    kind = dict(vectors.dtypes)[label] if label else "int"
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("label"), as_doubles(vec).alias("vec"))
    tree = pa.struct([("order", pa.binary()), ("starts", pa.list_(pa.binary())), ("points", pa.binary()), ("nodes", pa.list_(pa.list_(pa.binary())))])
    label_kind = to_arrow_type(rows.schema["label"].dataType)

    def block(ids: pa.Array, labels: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        made = []
        for part in np.split(x, parts, axis=1):
            order, starts, points = build(part)
            made.append({"order": packed(order), "starts": [packed(s) for s in starts], "points": packed(points), "nodes": [[packed(v) for v in level] for level in summed(points, starts)]})
        return pa.RecordBatch.from_pydict({"ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "labels": pa.array([labels.to_pylist()], pa.list_(label_kind)), "trees": pa.array([made], pa.list_(tree))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, labels, x = (list(c) for c in zip(*held, strict=True))
            held.clear()
            return block(pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(x))

        for batch in batches:
            took, x = whole_numbers(batch.column("vec"), scale, width)
            for at in range(0, len(took), ROWS):
                some = pa.array(took[at : at + ROWS])
                held.append((batch.column("id").take(some), batch.column("label").take(some), x[at : at + ROWS]))
                if sum(len(h[0]) for h in held) >= ROWS:
                    yield flush()
        if held:
            yield flush()
        give_back()

    return rows.mapInArrow(run, f"ids array<bigint>, labels array<{kind}>, trees array<struct<order: binary, starts: array<binary>, points: binary, nodes: array<array<binary>>>>")


def _tree(t: dict, d: int) -> tuple[np.ndarray, list[np.ndarray], list]:
    return unpacked(t["points"], d), [unpacked(s, 1).ravel() for s in t["starts"]], [tuple(unpacked(v, d) for v in level) for level in t["nodes"]]


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""
    parts, d = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for trees in batch.column("trees").to_pylist():
                for p, t in enumerate(trees):
                    points, starts, nodes = _tree(t, d)
                    whole, place, entry = filtered(starts, nodes, points, books[p])
                    np.add.at(sums[p], entry, points[place])
                    np.add.at(counts[p], entry, 1)
                    for level, node, of in whole:
                        np.add.at(sums[p], of, nodes[level][2][node])
                        np.add.at(counts[p], of, starts[level][node + 1] - starts[level][node])
        yield pa.RecordBatch.from_pydict(
            {"part": np.repeat(np.arange(parts, dtype=np.int32), [len(b) for b in books]), "entry": np.concatenate([np.arange(len(b), dtype=np.int32) for b in books]), "n": np.concatenate(counts), "sums": pa.array(np.concatenate(sums).tolist(), pa.list_(pa.int64()))}
        )
        give_back()

    wide = [F.sum(F.get("sums", j).cast("decimal(38,0)")).alias(f"s{j}") for j in range(d)]
    found = blocks.select("trees").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).filter("n > 0")
    out = [b.copy() for b in books]
    for r in found.collect():  # parts * entries rows
        out[r.part][r.entry] = [int(r[f"s{j}"]) // r.n for j in range(d)]
    return out


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vec_id: str = "vec_id", vec: str = "embedding", label: str | None = None) -> tuple[DataFrame | None, list[np.ndarray]]:
    """(blocks of trees, codebooks): begun with the parts of the first `entries` rows by id; None without rows."""
    with_workers(vectors.sparkSession)
    width = max(parts, width_of(vectors, vec, parts))
    blocks = stash(_trees(vectors, scale, width, parts, vec_id, vec, label), "trees")
    v = as_doubles(vec)
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ordered = vectors.filter(fine).select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), v.alias("vec")).orderBy(F.col("id").asc_nulls_last(), F.transform("vec", lambda x: F.floor(x * scale))).limit(entries)
    _, first = whole_numbers(ordered.toArrow().column("vec").combine_chunks(), scale, width)
    if not len(first):
        return None, []
    books = np.split(first, parts, axis=1)
    for _ in range(rounds):
        books = _round(blocks, books)
    return blocks, books


def encode(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of the rows in blocks: two hex digits for each part, and the squared distances' sum."""
    parts, d = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, trees in enumerate(batch.column("trees").to_pylist()):
                ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, t in enumerate(trees):
                    points, starts, nodes = _tree(t, d)
                    order, mine = unpacked(t["order"], 1).ravel(), np.zeros(len(ids), np.int64)
                    whole, place, entry = filtered(starts, nodes, points, books[p])
                    mine[place] = entry
                    for level, node, of in whole:
                        for i, e in zip(node.tolist(), of.tolist(), strict=True):
                            mine[starts[level][i] : starts[level][i + 1]] = e
                    codes[order, p] = mine
                    error[order] += ((points - books[p][mine]) ** 2).sum(1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "label": labels, "code": [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], "error": error})
        give_back()

    return blocks.mapInArrow(run, f"vec_id bigint, label {blocks.schema['labels'].dataType.elementType.simpleString()}, code string, error bigint")


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", most_broadcast: int = 1_000_000) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row per row that takes part."""
    blocks, books = fit(vectors, parts, entries, rounds, scale, vec_id, vec, label)
    if blocks is None:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = stash(encode(blocks, books), "codes")
    by_label = sent_whole(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), most_broadcast)
    out = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
