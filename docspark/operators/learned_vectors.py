"""Text vectors that are learned from the corpus itself, in place of hashed counts.

Words fall into `words` buckets by hash, so every word has a place and the model's size is a parameter. Words that stand
near each other are counted over whole texts, in batches within tasks and then by key; positive pointwise mutual
information weighs the counts. The matrix's leading directions are found by block power iteration from a seeded random
block: each round multiplies the distributed matrix, a row for each bucket, by a block of words x (dim + extra) numbers.
The driver orthonormalises that block, and never holds the matrix. A text's vector is the mean of its words' vectors, rare words
first, without the direction that all texts share.

Null and empty texts, and texts of unseen words only, have the zero vector; a corpus without pairs gives every text the
zero vector. Repeated rows count as often as they stand there. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import WORD, text_of
from docspark.plans.shared import drop_stash, stash

#: Pairs that a task holds before it counts them and passes the counts on.
HELD = 1 << 22
#: The least number of places that pairs are dealt to, and about how many pairs a place has at most.
PLACES, SPAN = 1 << 10, 1 << 20
#: Numbers of a packed row at most: what a task unpacks at once, in a dozen arrays of 8 bytes each.
PIECE = 1 << 17
BLOCK_NAMES = ["place", "wide", "size", "steps", "n"]
BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
BLOCKS = "place int, wide int, size int, steps binary, n binary"


def words_of(text: Column) -> Column:
    """array<string>: the words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit(WORD), F.lit(0))


def buckets(column: pa.ListArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words of a batch, and where each text's begin and end; each distinct word is hashed once."""
    flat = column.flatten().dictionary_encode()
    hashed = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4]) % words for w in flat.dictionary.to_pylist()], np.int64)  # noqa: S324
    offs = column.offsets.to_numpy()
    return hashed[flat.indices.to_numpy()], offs - offs[0]


def _places(words: int) -> tuple[int, int]:
    """How many places pairs are dealt to by their number, and how many numbers a place has at most (SPAN, about)."""
    places = max(PLACES, -(-words * words // SPAN))
    return places, -(-words * words // places)


def _packed(place: int, values: np.ndarray, n: np.ndarray) -> tuple:
    """Ascending numbers as steps from one to the next, and counts, each in as few bytes as the largest needs."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    steps, n = (x.astype(np.min_scalar_type(x.max())) for x in (steps, n))
    return place, steps.itemsize, n.itemsize, steps.tobytes(), n.tobytes()


def _unpacked(wide: int, size: int, steps: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(steps, f"u{wide}"), dtype=np.int64), np.frombuffer(n, f"u{size}").astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOCK_TYPES, strict=True)], names=BLOCK_NAMES)


def pair_blocks(docs: DataFrame, words: int, reach: int = 4, text: str = "text") -> DataFrame:
    """How often two buckets stand at most `reach` words apart in a text: packed rows of at most PIECE pairs of a place,
    each pair once, the lower bucket first. Tasks count before they pass on; a place adds up in an array of at most about SPAN counts,
    whatever the corpus."""
    places, span = _places(words)
    kind = np.uint32 if places * span < 1 << 32 else np.uint64

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        ends = np.searchsorted(code, np.arange(places + 1, dtype=np.uint64) * np.uint64(span))
        filled = np.flatnonzero(np.diff(ends))
        return _batch([_packed(p, code[ends[p] : ends[p + 1]] - kind(p * span), n[ends[p] : ends[p + 1]]) for p in filled.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            column = batch.column(0)
            word, offs = buckets(column, words)
            own = np.repeat(np.arange(len(column)), np.diff(offs))
            step = HELD // reach
            for at in range(0, len(word), step):  # a very long text is counted in parts as well
                part, rows = word[at : at + step + reach], own[at : at + step + reach]
                for d in range(1, reach + 1):
                    m = max(0, min(step, len(part) - d))
                    same = rows[:m] == rows[d : d + m]
                    a, b = part[:m][same], part[d : d + m][same]
                    value, place = np.divmod(np.minimum(a, b) * words + np.maximum(a, b), places)
                    held.append((place * span + value).astype(kind))
                    size += len(a)
                if size >= HELD:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, at = np.zeros(span, np.int64), None
        for batch in batches:
            for place, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at not in (None, place):
                    yield from whole(at, sums)
                    sums[:] = 0
                values, n = _unpacked(*packed)
                sums[values] += n  # a row has a number once
                at = place
        if at is not None:
            yield from whole(at, sums)

    def whole(place: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        values = np.flatnonzero(sums)
        for begin in range(0, len(values), PIECE):
            some = values[begin : begin + PIECE]
            yield _batch([_packed(place, some, sums[some])])

    parts = docs.select(words_of(F.col(text)).alias("b")).mapInArrow(run, BLOCKS)
    return parts.repartition("place").sortWithinPartitions("place").mapInArrow(merged, BLOCKS)


def _pairs_of(row: tuple, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, n) of a packed row, both directions of each pair; a bucket beside itself counts twice."""
    place, *packed = row
    values, n = _unpacked(*packed)
    low, high = np.divmod(values * _places(words)[0] + place, words)
    two = low != high
    return np.concatenate([low, high[two]]), np.concatenate([high, low[two]]), np.concatenate([np.where(two, n, 2 * n), n[two]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def near_words(docs: DataFrame, words: int, reach: int = 4, text: str = "text") -> DataFrame:
    """(word, context, n): how often two buckets stand at most `reach` words apart in a text, from either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            word, context, n = _pairs_of(row, words)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(context, pa.int32()), pa.array(n)], names=["word", "context", "n"])

    return pair_blocks(docs, words, reach, text).mapInArrow(run, "word int, context int, n bigint")


def totals(blocks: DataFrame, words: int) -> np.ndarray:
    """How many pairs each bucket is in: one number a bucket, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(words, np.int64)
        for row in _rows(batches):
            word, _, n = _pairs_of(row, words)
            np.add.at(own, word, n)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(own[at])], names=["word", "n"])

    out = np.zeros(words, np.int64)
    for word, n in blocks.mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n")).collect():
        out[word] = n
    return out


class _Weights:
    """Positive mutual information of a packed row's pairs; contexts' counts are raised to `power`."""

    def __init__(self, own: np.ndarray, power: float):
        self.own = own.astype(np.float64)
        self.other = self.own**power
        self.powers = self.other.sum()

    def of(self, row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, context, n, weight) of those above 0."""
        word, context, n = _pairs_of(row, len(self.own))
        weight = np.log(n * self.powers / (self.own[word] * self.other[context]))
        up = weight > 0
        return word[up], context[up], n[up], weight[up]


def weighed(blocks: DataFrame, own: np.ndarray, power: float = 0.75) -> DataFrame:
    """(word, context, weight) of pairs whose positive mutual information is above 0."""
    held = blocks.sparkSession.sparkContext.broadcast(_Weights(own, power))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            word, context, _, weight = held.value.of(row)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(context, pa.int32()), pa.array(weight.astype(np.float32))], names=["word", "context", "weight"])

    return blocks.mapInArrow(run, "word int, context int, weight float")


def neighbourhoods(blocks: DataFrame, own: np.ndarray, power: float = 0.75) -> DataFrame:
    """(word, contexts, n, weight): for each bucket its contexts of positive mutual information, how often they meet, and its sum."""
    held, words = blocks.sparkSession.sparkContext.broadcast(_Weights(own, power)), len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, met, sums = np.zeros(words, np.int64), np.zeros(words, np.int64), np.zeros(words)
        for row in _rows(batches):
            word, _, n, weight = held.value.of(row)
            contexts += np.bincount(word, minlength=words)
            np.add.at(met, word, n)
            sums += np.bincount(word, weights=weight, minlength=words)
        at = np.flatnonzero(contexts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(contexts[at]), pa.array(met[at]), pa.array(sums[at])], names=["word", "contexts", "n", "weight"])

    parts = blocks.mapInArrow(run, "word int, contexts bigint, n bigint, weight double")
    return parts.groupBy("word").agg(F.sum("contexts").alias("contexts"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))


@dataclass(frozen=True)
class Model:
    """A vector and a weight for each bucket, and the direction that all texts share."""

    vectors: np.ndarray
    weights: np.ndarray
    shared: np.ndarray

    def of(self, found: list[np.ndarray]) -> np.ndarray:
        """The unit vectors of texts by their buckets."""
        out = np.zeros((len(found), self.vectors.shape[1]))
        for i, b in enumerate(found):
            at, n = np.unique(b, return_counts=True)
            out[i] = (self.weights[at] * n) @ self.vectors[at]
        out -= np.outer(out @ self.shared, self.shared)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length < 1e-12, np.inf, length)


def fit(docs: DataFrame, dim: int = 384, words: int = 1 << 15, rounds: int = 2, reach: int = 4, rare: float = 1e-4, spectrum: float = 0.0, seed: int = 0, text: str = "text") -> Model:
    """Learns from all texts. The driver holds a few blocks of words x (dim + 16) numbers, whatever the corpus.

    A word of the share p among all words counts as rare / (rare + p), a direction as its value to the power of
    `spectrum`: at 0 all count alike, which tells passages apart; at 0.5 the few that tell languages apart outweigh the
    rest. Directions whose value isn't above 0 are zero. The same rows, parameters and seed give the same
    model: each bucket's row of the matrix is in order, so its product doesn't hang on partitions.
    """
    pairs = stash(pair_blocks(docs, words, reach, text), "pairs")
    seen = totals(pairs, words).astype(np.float64)
    entry = F.struct("context", "weight")
    # A bucket meets each other bucket once, so a row has at most `words` entries.
    lines = weighed(pairs, seen).groupBy("word").agg(F.array_sort(F.collect_list(entry)).alias("line"))
    matrix = stash(lines.select("word", F.col("line.context").alias("context"), F.col("line.weight").alias("weight")), "matrix")
    size = min(dim + 16, words)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(words, size)))[0]
    for _ in range(rounds):
        block = np.linalg.qr(_times(matrix, block))[0]
    inner = block.T @ _times(matrix, block)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-values)[: min(dim, size)]
    top = values[best]
    vectors = block @ turn[:, best] * np.where(top > 1e-9 * (np.abs(values).max() or 1.0), np.abs(top) ** spectrum, 0.0)
    drop_stash(pairs, matrix)
    share = seen / max(1.0, seen.sum())
    weights = rare / (rare + share)
    usual = (share * weights) @ vectors
    return Model(vectors.astype(np.float32), weights, usual / (np.linalg.norm(usual) or 1.0))


def _times(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """The matrix times a block: rows stay where they are, the block goes to all tasks, and a row of the product comes back for each bucket."""
    held = matrix.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            word, context, weight = batch.columns
            ends, at, by = context.offsets.to_numpy(), context.flatten().to_numpy(), weight.flatten().to_numpy().astype(np.float64)
            start = ends[0]
            made = [(by[a:b] @ own[at[a:b]]).tobytes() for a, b in zip(ends[:-1] - start, ends[1:] - start, strict=True)]
            yield pa.RecordBatch.from_arrays([word, pa.array(made, pa.binary())], names=["word", "made"])

    out = np.zeros_like(block)
    for word, made in matrix.mapInArrow(run, "word int, made binary").collect():  # at most `words` rows
        out[word] = np.frombuffer(made)
    held.unpersist()
    return out


def embed(df: DataFrame, model: Model, text: str = "text", name: str = "vec") -> DataFrame:
    """df with the unit vectors of its texts; the model goes to all tasks once."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for part in parts:
            word, offs = buckets(part, len(own.weights))
            made = own.of([word[x:y] for x, y in zip(offs[:-1], offs[1:], strict=True)])
            yield pa.array(list(made), pa.list_(pa.float64()))

    return df.withColumn(name, run(words_of(F.col(text))))
