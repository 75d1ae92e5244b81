"""Quality classifier by Bradley-Terry pairwise ranking.

Documents are described by counts over the whole text (kinds of bytes, word lengths, repeats) and by the frequencies of
hashed words and of hashed runs of three bytes. All labelled rows are learned from: their features are dealt into blocks
of about ROWS rows by the hash of doc_id, and in each block good documents are paired with bad ones, every row in PARTNERS
pairs at least; rows of the rarer label are copied into several blocks where there would be fewer than PARTNERED in each.
A weight vector is learned by logistic loss on the difference of features, with a small ridge: each step is a pass over
the blocks, of which only sums leave a block. Pairs only name documents, and no difference is ever stored. The threshold
is the quantile of all labelled rows' scores at the share of bad documents among them; it is laid at 0.7 of the 0 to 1
scale, on which scores keep their order.

Defined cases: null and empty text have all features 0 and get a score like any text; without rows of both labels every
document gets the threshold's score, so nothing is rejected; equal texts get equal scores; labels that contradict each
other are left out; rows that repeat a doc_id are learned from as one, and are rows of their own in the result. Extra columns
pass through, whatever their names, but for the one that has the score's name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType

from docspark.llm.common import BATCH_BYTES, LOWER, drop_stash, sent_whole, settings, slices, span_hashes, stash, text_column, tidy, word_spans

AT = 0.7  # where the threshold lies on the scale of scores
#: Rows of a block, in how many pairs each is at least, and how many rows of each label a block should have.
ROWS, PARTNERS, PARTNERED = 4096, 4, 64
#: Up to so many labels are broadcast; beyond, documents meet them by a shuffle.
SENT = 2_000_000
#: A block lies in so many rows, of about 270 kB each, so that the JVM never has a block in one buffer. They are a file of
#: one row group, which Spark reads in one task, in pages and batches of a few.
PIECES = 32
FILES = {"maxRecordsPerFile": str(PIECES), "parquet.block.size": str(128 << 20), "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
READ = {"spark.sql.parquet.columnarReaderBatchSize": "4", BATCH_BYTES: "1m"}


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[list(chars.encode())] = 1
    return out


CLASSES = {
    "symbols": _bytes("#*$%&|<>@^~=+_{}[]\\/"),
    "capitals": _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "shouts": _bytes("!?"),
    "digits": _bytes("0123456789"),
    "stops": _bytes(".,;:"),
    "other": np.r_[np.zeros(128), np.ones(128)],
}


#: Buckets of hashed words, and as many of hashed byte trigrams.
BUCKETS = 256
#: What one of them counts beside a count, as they are many: the ridge then weighs 25 times as much on them.
SMALL = 0.2


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of numbers for each text of a slice: counts, then n-grams."""
    return np.hstack([counts(data, offs), ngrams(data, offs)])


def ngrams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Roots of the frequencies of hashed words and byte trigrams, A-Z lower-cased."""
    n_rows, low = len(offs) - 1, LOWER[data]
    starts, ends, row = word_spans(low, offs)
    words = (span_hashes(low, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    where = np.repeat(np.arange(n_rows), np.diff(offs))
    own = where[:-2] == where[2:]
    three = low.astype(np.uint32)
    tri = ((three[:-2] << 16 | three[1:-1] << 8 | three[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64) % BUCKETS
    shares = [np.bincount(at * BUCKETS + b, minlength=n_rows * BUCKETS).reshape(n_rows, BUCKETS) for at, b in ((row, words), (where[:-2][own], tri[own]))]
    return np.hstack([np.sqrt(x / np.maximum(1, x.sum(1, keepdims=True))) for x in shares])


def counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Shares of kinds of bytes, word lengths, repeats of words and lines."""
    n_rows = len(offs) - 1
    starts, ends, row = word_spans(data, offs)
    words = span_hashes(data, starts, ends)
    n_words = np.bincount(row, minlength=n_rows).astype(float)
    n_bytes = np.maximum(1.0, np.diff(offs))
    some = np.maximum(1.0, n_words)
    cols = [np.log1p(n_words)]
    where = np.repeat(np.arange(n_rows), np.diff(offs))
    for table in CLASSES.values():
        share = np.bincount(where, table[data], n_rows) / n_bytes
        cols += [share, np.sqrt(share)]
    cols.append(np.log1p(np.bincount(row, ends - starts, n_rows) / some))
    again = np.append(False, (words[1:] == words[:-1]) & (row[1:] == row[:-1])) if len(words) else np.zeros(0, bool)
    share = np.bincount(row[again], minlength=n_rows) / some
    cols += [share, np.sqrt(share)]
    order = np.lexsort((words, row))
    w, r = words[order], row[order]
    fresh = np.append(True, (w[1:] != w[:-1]) | (r[1:] != r[:-1])) if len(w) else np.zeros(0, bool)
    cols.append(np.bincount(r[fresh], minlength=n_rows) / some)
    # Lines with a word, and how many of them are seen before in the text.
    first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    breaks = np.cumsum(np.append(0, data == 10))
    first |= np.append(True, breaks[starts[1:]] != breaks[starts[:-1]]) if len(row) else False
    begin = np.flatnonzero(first)
    stop = ends[np.append(begin[1:] - 1, len(ends) - 1)] if len(begin) else begin
    lines, lrow = span_hashes(data, starts[begin], stop), row[begin]
    order = np.lexsort((lines, lrow))
    h, r = lines[order], lrow[order]
    dup = np.append(False, (h[1:] == h[:-1]) & (r[1:] == r[:-1])) if len(h) else np.zeros(0, bool)
    cols.append(np.bincount(r[dup], minlength=n_rows) / np.maximum(1, np.bincount(lrow, minlength=n_rows)))
    return np.stack(cols, 1)


#: How many features there are.
WIDTH = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


@dataclass
class Ranker:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = standard(x, self.mean, self.spread) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)) * (1 - AT) / AT)


def standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = x - mean
    z /= spread
    return np.clip(z, -8, 8, out=z)


def least(loss, start: np.ndarray, steps: int = 300, kept: int = 10, gain: float = 1e-12) -> np.ndarray:
    """Where loss, which gives its value and gradient, is least: a quasi-Newton search of limited memory, until a step
    gains less than this part of the loss."""
    w, (value, slope) = start, loss(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, shares = slope.copy(), []
        for s, y in reversed(moves):
            shares.append(s @ way / (y @ s))
            way -= shares[-1] * y
        if moves:
            s, y = moves[-1]
            way *= s @ y / (y @ y)
        for (s, y), share in zip(moves, reversed(shares), strict=True):
            way += s * (share - y @ way / (y @ s))
        length = 1.0
        while (there := loss(w - length * way))[0] > value - 1e-4 * length * (slope @ way) and length > 1e-10:
            length /= 2
        step, turn, gained = -length * way, there[1] - slope, value - there[0]
        w, (value, slope) = w + step, there
        if gained <= gain * abs(value):
            break
        if step @ turn > 0:
            moves = [*moves[1 - kept :], (step, turn)]
    return w


def unlearned(width: int) -> Ranker:
    """What gives every text the threshold's score."""
    return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0)


def pull(z: np.ndarray, w: np.ndarray, better: np.ndarray, worse: np.ndarray) -> tuple[float, np.ndarray]:
    """The logistic loss of pairs of rows of z, summed, and its gradient."""
    score = z @ w
    margin = np.clip(score[better] - score[worse], -30, 30)
    doubt = 1 / (1 + np.exp(margin))
    each = np.bincount(better, doubt, len(z)) - np.bincount(worse, doubt, len(z))
    return float(np.log1p(np.exp(-margin)).sum()), -(z.T @ each)


def train(x: np.ndarray, good: np.ndarray, pairs: int = 100_000, ridge: float = 1e-3, seed: int = 5, small: int = 0) -> Ranker:
    """Learns from features and labels (1: good) in memory; the last `small` features count SMALL times as much as the others."""
    if not len(x) or good.all() or not good.any():
        return unlearned(WIDTH if x.ndim < 2 else x.shape[1])
    mean, spread = x.mean(0, dtype=np.float64), np.maximum(x.std(0, dtype=np.float64), 1e-6)
    spread[x.shape[1] - small :] /= SMALL
    z, rng = standard(x, mean, spread), np.random.default_rng(seed)
    ones, zeros = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    better, worse = rng.choice(ones, pairs), rng.choice(zeros, pairs)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = pull(z, w, better, worse)
        return value / pairs + ridge / 2 * (w @ w), ridge * w + slope / pairs

    w = least(loss, np.zeros(z.shape[1]))
    return Ranker(mean, spread, w, float(np.quantile(z @ w, len(zeros) / len(good), method="midpoint")))


def _of_texts(docs: DataFrame, kind: DataType, make, text: str):
    """A column of what make returns for the features of each text: a number, or bytes."""

    def run(column: pa.Array) -> pa.Array:
        rows = [x for _, data, offs in slices(column) for x in make(features(data, offs))]
        return pa.array(rows, pa.float64() if kind == DoubleType() else pa.binary())

    return text_column(docs.sparkSession, kind, lambda: run)(F.col(f"`{text}`").cast("string"))


def _labelled(docs: DataFrame, labels: DataFrame, text: str) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, q, text) of all rows that have one label, an id once, and how many there are of each label."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).filter("q = q2").drop("q2")
    known = stash(known, "known")
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(sent_whole(known, SENT), "doc_id")
    found = rows.groupBy("doc_id", "q").count().groupBy("q").agg(F.count("*").alias("n"), F.max("count").alias("most")).collect()  # two rows
    if any(r.most > 1 for r in found):  # of rows that repeat an id the one of the lowest hash
        rows = rows.groupBy("doc_id", "q").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "q", "t.text")
    return rows, {r.q: r.n for r in found}


def _dealt(rows: DataFrame, sizes: dict[int, int], pieces: int = 1) -> DataFrame:
    """(block, x, good, own): features and labels of blocks of about ROWS rows, each as so many pieces; own is 1 in one block of a row's."""
    n = -(-sum(sizes.values()) // ROWS)
    copies = {q: min(n, -(-n * PARTNERED // size)) for q, size in sizes.items()}
    place, h = F.pmod(F.xxhash64("doc_id"), F.lit(n)), F.xxhash64("doc_id", F.lit(1))
    made = rows.select("q", place.alias("place"), h.alias("h"), _of_texts(rows, BinaryType(), lambda x: [r.tobytes() for r in x.astype(np.float32)], "text").alias("x"))
    each = F.sequence(F.lit(0), F.when(F.col("q") == 1, copies[1]).otherwise(copies[0]) - 1)
    dealt = made.select("q", "h", "x", "place", F.explode(each).alias("copy")).withColumn("block", (F.col("place") + F.col("copy")) % n)

    def packed(part: pa.Table) -> pa.Table:
        part = part.sort_by([("h", "ascending"), ("x", "ascending")])
        block, good, own = part["block"][0], part["q"].to_numpy().astype(np.int8), part["copy"].to_numpy() == 0
        edges = [len(good) * k // pieces for k in range(pieces + 1)]
        made = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            columns = [b"".join(part["x"][a:b].to_pylist()), good[a:b].tobytes(), own[a:b].tobytes()]
            made.append(pa.RecordBatch.from_arrays([pa.array([block.as_py()]), *(pa.array([c]) for c in columns)], names=["block", "x", "good", "own"]))
        return pa.Table.from_batches(made)

    return dealt.select("block", "q", "h", "x", "copy").groupBy("block").applyInArrow(packed, "block bigint, x binary, good binary, own binary")


def _over(blocks: DataFrame, make, fields: str) -> DataFrame:
    """make(block, features, labels, own) of each block, a tuple of columns."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Scalar, ...]] = []
        for batch in batches:
            for piece in zip(*(batch.column(k) for k in range(4)), strict=True):
                held.append(piece)
                if len(held) < PIECES:
                    continue
                if len({block.as_py() for block, *_ in held}) > 1:
                    raise ValueError("a block isn't in one task")
                x, good, own = (np.concatenate([np.frombuffer(p[k].as_buffer(), kind) for p in held]) for k, kind in ((1, np.float32), (2, np.int8), (3, bool)))
                held.clear()
                made = make(piece[0].as_py(), x.reshape(len(good), -1), good, own)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=names)
        if held:
            raise ValueError("a block isn't in one task")

    return blocks.select("block", "x", "good", "own").mapInArrow(tidy(run), fields)


def _sums(blocks: DataFrame, make) -> np.ndarray:
    """What make returns for each block, a few numbers a feature, as rows in order of the blocks, so that sums don't hang on tasks."""
    got = _over(blocks, lambda block, *rest: ([block], [make(block, *rest).tobytes()]), "block bigint, sums binary").toArrow().sort_by("block")
    return np.stack([np.frombuffer(s, np.float64) for s in got["sums"].to_pylist()])


def pairs_of(block: int, good: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Good and bad rows of a block, paired: each row PARTNERS times at least, those of one label equally often, but for one time."""
    ones, zeros = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(ones) or not len(zeros):
        return ones[:0], zeros[:0]
    rng, n = np.random.default_rng([seed, block]), PARTNERS * max(len(ones), len(zeros))
    drawn = [np.concatenate([rng.permutation(side) for _ in range(-(-n // len(side)))])[:n] for side in (ones, zeros)]
    return drawn[0], drawn[1]


def ranked(values: DataFrame, rank: int, bins: int = 4096) -> float:
    """The value of this rank, from 0, of a column `value`: bins are counted, and then those of the bin that holds it."""
    low, high = values.agg(F.min("value"), F.max("value")).first()
    before = 0
    while low < high:
        width = max((high - low) / bins, 5e-324)
        at = F.least(F.lit(bins - 1), F.floor((F.col("value") - low) / width))
        found = values.filter(F.col("value").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        for r in sorted(found.collect()):  # at most `bins`
            low, high = r.low, r.high
            if before + r.n > rank:
                break
            before += r.n
    return low


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ridge: float = 1e-3, seed: int = 5) -> Ranker:
    """Learns from all rows of docs that labels (doc_id, quality) covers; labels that contradict each other are left out."""
    rows, sizes = _labelled(docs, labels, text)
    if len(sizes) < 2:
        return unlearned(WIDTH)
    blocks = stash(_dealt(rows, sizes, PIECES), "labelled", FILES)
    with settings(docs.sparkSession, READ):
        return _learned(blocks, sizes, ridge, seed)


def _learned(blocks: DataFrame, sizes: dict[int, int], ridge: float, seed: int) -> Ranker:
    """Learns from blocks, which are dropped then."""
    total, bad = sum(sizes.values()), sizes[0]
    mean = _sums(blocks, lambda block, x, good, own: x[own].sum(0, dtype=np.float64)).sum(0) / total
    spread = np.maximum(np.sqrt(_sums(blocks, lambda block, x, good, own: ((x[own] - mean) ** 2).sum(0)).sum(0) / total), 1e-6)
    spread[WIDTH - 2 * BUCKETS :] /= SMALL

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        def of(block: int, x: np.ndarray, good: np.ndarray, own: np.ndarray) -> np.ndarray:
            better, worse = pairs_of(block, good, seed)
            value, slope = pull(standard(x, mean, spread), w, better, worse)
            return np.r_[len(better), value, slope]

        got = _sums(blocks, of).sum(0)
        return got[1] / got[0] + ridge / 2 * (w @ w), ridge * w + got[2:] / got[0]

    w = least(loss, np.zeros(WIDTH), gain=1e-7)
    scores = stash(_over(blocks, lambda block, x, good, own: (standard(x[own], mean, spread) @ w,), "value double"), "scores")
    at = (total - 1) * bad / total
    threshold = (ranked(scores, math.floor(at)) + ranked(scores, math.ceil(at))) / 2
    drop_stash(blocks, scores)
    return Ranker(mean, spread, w, threshold)


def score(docs: DataFrame, ranker: Ranker, text: str = "text", name: str = "score") -> DataFrame:
    """docs without text, with a score, 0 to 1, higher is better; from AT on above the threshold."""
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (text, name)), _of_texts(docs, DoubleType(), ranker, text).alias(name))


def keep_good(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """The rows of docs at or above the threshold, with all their columns."""
    return docs.filter(_of_texts(docs, DoubleType(), ranker, text) >= AT)
