"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces of the product of their probabilities, found by the forward algorithm; a text's is
the product over its words. Probabilities are learned by expectation maximisation: a backward pass gives each piece its
expected count over all segmentations of the words of a language. The prediction is the language of the highest
posterior under equal priors.

Learning uses a bounded sample of the labelled rows, lowest hashes of doc_id first: `rows` over all languages, and of
every language `each` at least, or all it has, so none is left out; scoring takes every word of every text. Forward
passes run over many distinct words at once. A pass over a very long run of letters goes tile by tile and carries the
last LONGEST sums over, so its memory is bounded and its sum is that of the whole run.

Words are runs of letters, lower-cased, with a space mark in front; characters outside the vocabulary cost a fixed
floor for every language. Defined cases: null text, or text without a letter, is `und` with score 0; ties go to the
language first in order; a table without labelled rows gives `und` for all; rows that repeat a doc_id and lang are one
in the sample, and rows of their own in the result. Extra columns pass through, whatever their names, but for those
that have the name of a result.
"""

from __future__ import annotations

import base64
import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from docspark.llm.common import map_texts, stash, text_blocks, text_column

MARK = " "
LONGEST = 12
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = -25.0
#: A letter run beyond this many characters is scored by itself, in tiles of that length.
RUN = 4096
#: Up to this length no product of piece probabilities leaves the range of a double, and sums need no scale.
SHORT = 24
CELLS = 120_000


@functools.lru_cache(2)
def vocabulary(ranks: str) -> dict[str, int]:
    """Lower-case pieces of letters, with or without a leading space, of a public byte-pair rank file."""
    found: dict[str, int] = {}
    with open(ranks, "rb") as f:
        for line in f:
            try:
                piece = base64.b64decode(line.split()[0]).decode()
            except UnicodeDecodeError:
                continue
            bare = piece[1:] if piece[:1] == MARK else piece
            if len(piece) <= LONGEST and (bare.isalpha() and bare == bare.lower() or piece == MARK):
                found.setdefault(piece, len(found))
    for c in map(chr, range(0xDF, 0x250)):  # so that every common letter has a piece of its own
        if c.isalpha() and c == c.lower():
            found.setdefault(c, len(found))
    return found


def words_of(text: str) -> list[str]:
    return [MARK + w for w in LETTERS.findall(text.lower())]


SLOTS = 20  # log2 of a lookup table's slots
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _slots(hashes: np.ndarray, factor: np.uint64) -> np.ndarray:
    return ((hashes * factor) >> np.uint64(64 - SLOTS)).astype(np.int64)


@functools.lru_cache(2)
def lookup(ranks: str) -> tuple[np.ndarray, list[tuple[np.uint64, np.ndarray]]]:
    """Each piece's hash, and two tables from slots to pieces (-1: none); what is not free in the first is in the second."""
    pieces = list(vocabulary(ranks))
    hashes = np.zeros(len(pieces) + 1, np.uint64)
    for k, p in enumerate(pieces):
        h = 0
        for c in p:
            h = (h * int(FACTOR) + ord(c) + 1) % (1 << 64)
        hashes[k] = h
    rng, left, tables = np.random.default_rng(9), np.arange(len(pieces)), []
    while len(left) or not tables:
        factor = rng.integers(1, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        slots = _slots(hashes[left], factor)
        _, first = np.unique(slots, return_index=True)
        table = np.full(1 << SLOTS, -1, np.int32)
        table[slots[first]] = left[first]
        tables.append((factor, table))
        left = np.delete(left, first)
    return hashes, tables


def lattice(words: list[str], ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and pieces[w, end - 1, n - 1]: the piece of n characters that ends there, or -1.

    The hashes of all substrings of one length come from those one shorter, over all words at once.
    """
    hashes, tables = lookup(ranks)
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max())
    chars = np.zeros((len(words), width), np.uint64)
    chars[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    found = np.full((len(words), width, LONGEST), -1, np.int32)
    own = chars + np.uint64(1)
    h = own.copy()
    for n in range(1, min(LONGEST, width) + 1):
        if n > 1:
            h = h[:, :-1] * FACTOR + own[:, n - 1 :]
        hit = np.full(h.shape, -1, np.int32)
        for factor, table in tables:
            at = table[_slots(h, factor)]
            hit = np.where((at >= 0) & (hashes[at] == h), at, hit)
        found[:, n - 1 :, n - 1] = hit
    found[np.arange(width) >= lengths[:, None]] = -1
    return lengths, found


def groups(words: list[str], longest: int | None = None):
    """Indices of words of like length, of at most `longest` characters, with a bounded number of characters together."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    at, n = 0, int(np.searchsorted(sizes, longest, "right")) if longest else len(words)
    while at < n:
        near = sizes[at : min(n, at + CELLS)]
        end = at + max(1, int((np.arange(1, len(near) + 1) * near <= CELLS).sum()))
        yield order[at:end]
        at = end


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # language x piece
    ranks: str

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log probability of each word under each language, a row per word."""
        out = np.zeros((len(words), len(self.langs)))
        for part in groups(words, RUN):
            out[part] = self._forward([words[i] for i in part])[0]
        for i, word in enumerate(words):
            if len(word) > RUN:
                out[i] = self._tiled(word)
        return out

    def _tiled(self, word: str) -> np.ndarray:
        """The same sum for one long word: of all sums so far only the last LONGEST are kept, and the log of what they were divided by."""
        floor, logs = np.exp(UNKNOWN), np.zeros(len(self.langs))
        sums = np.zeros((LONGEST + RUN, len(self.langs)))
        sums[LONGEST - 1] = 1
        for at in range(0, len(word), RUN):
            begin = max(0, at - LONGEST + 1)
            found = lattice([word[begin : at + RUN]], self.ranks)[1][0, at - begin :]
            p = self._p[found]
            p[:, 0] += floor * (found[:, :1] < 0)
            for e in range(len(found)):
                here = slice(e, e + LONGEST)
                sums[e + LONGEST] = (sums[here][::-1] * p[e]).sum(0)
                if e % 8 == 7 or e == len(found) - 1:
                    by = sums[e + LONGEST].copy()
                    sums[e + 1 : e + LONGEST + 1] /= by
                    logs += np.log(by)
            sums[:LONGEST] = sums[len(found) : len(found) + LONGEST]
        return logs

    @functools.cached_property
    def _p(self) -> np.ndarray:
        """piece x language; the last row, which -1 finds, is no piece."""
        return np.vstack([np.exp(self.logp).T, np.zeros(len(self.langs))])

    def _forward(self, words: list[str]):
        """log of the sums over all segmentations of each word, and the sums up to each place with the log of what they
        are divided by; a character that is no piece costs UNKNOWN."""
        lengths, found = lattice(words, self.ranks)
        n, width, _ = found.shape
        p, floor = self._p, np.exp(UNKNOWN)
        alpha = np.zeros((n, width + 1, len(self.langs)))
        scale = np.zeros((n, width + 1 if width > SHORT else 1, len(self.langs)))
        alpha[:, 0] = 1
        for e in range(1, width + 1):
            k = min(e, LONGEST)
            before = alpha[:, e - k : e]
            if width > SHORT:
                before = before * np.exp(scale[:, e - k : e] - scale[:, e - 1 : e])
            total = (before[:, ::-1] * p[found[:, e - 1, :k]]).sum(1)
            total += before[:, -1] * (floor * (found[:, e - 1, :1] < 0))
            if width > SHORT:
                total = np.maximum(total, 1e-290)
                scale[:, e] = scale[:, e - 1] + np.log(total)
                alpha[:, e] = 1
            else:
                alpha[:, e] = total
        every = np.arange(n)
        logs = np.log(alpha[every, lengths]) + scale[every, lengths if width > SHORT else 0]
        return logs, alpha, scale, found, lengths

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected piece counts, language x piece; weights: word x language.

        `ends` is the probability that a piece ends at a place; what a piece there has of it is what it has of the sum up to there.
        """
        size, floor = self.logp.shape[1], np.exp(UNKNOWN)
        counts = np.zeros((len(self.langs), size))
        for part in groups(words):
            _, alpha, scale, found, lengths = self._forward([words[i] for i in part])
            n, width, _ = found.shape
            ends = np.zeros((n, width + 1, len(self.langs)))
            ends[np.arange(n), lengths] = 1
            for e in range(width, 0, -1):
                k = min(e, LONGEST)
                before = alpha[:, e - k : e][:, ::-1] / alpha[:, e : e + 1]
                if width > SHORT:
                    before = before * np.exp(scale[:, e - k : e][:, ::-1] - scale[:, e : e + 1])
                piece = found[:, e - 1, :k]
                part_of = ends[:, e : e + 1] * before
                share = part_of * self._p[piece]
                ends[:, e - k : e] += share[:, ::-1]
                ends[:, e - 1] += part_of[:, 0] * (floor * (piece[:, :1] < 0))
                w, j = np.nonzero(piece >= 0)
                at, post = piece[w, j], share[w, j] * weights[part][w]
                for k_lang in range(len(self.langs)):
                    counts[k_lang] += np.bincount(at, post[:, k_lang], size)
        return counts


def train(texts: list[str], langs: list[str], ranks: str, rounds: int = 4, prior: float = 0.05) -> Model | None:
    """Learns piece probabilities; None without labelled text."""
    names = sorted(set(langs))
    if not names:
        return None
    index: dict[str, int] = {}
    tally: list[np.ndarray] = []
    for text, lang in zip(texts, langs, strict=True):
        k = names.index(lang)
        for w in words_of(text):
            i = index.setdefault(w, len(index))
            if i == len(tally):
                tally.append(np.zeros(len(names)))
            tally[i][k] += 1
    size = len(vocabulary(ranks))
    model = Model(names, np.full((len(names), size), -np.log(size)), ranks)
    if not index:
        return model
    weights = np.array(tally)
    words = list(index)
    for _ in range(rounds):
        counts = model.expected(words, weights) + prior
        model = Model(names, np.log(counts / counts.sum(1, keepdims=True)), ranks)
    return model


def _below(n, wanted: int):
    """The 64-bit number below which four times `wanted` of n hashes lie, on average."""
    share = F.least(F.lit(1.0), F.lit(4.0 * wanted) / F.greatest(n, F.lit(1)))
    return F.when(share < 1, ((share * 2 - 1) * F.lit(float(1 << 63))).cast("bigint")).otherwise(F.lit((1 << 63) - 1))


def sample(docs: DataFrame, rows: int, each: int = 150) -> tuple[list[str], list[str]]:
    """Texts and langs of labelled rows: the `rows` of the lowest hashes of doc_id over all, and the `each` of every lang.

    Only ids are ranked, and only those whose hash lies below where about four times as many rows do as are wanted; should
    fewer than wanted be there, all are ranked. So no task gets rows of all others, nor a language's. Rows that repeat a
    doc_id and lang are one, the text of the lowest hash."""
    usable = docs.filter("doc_id is not null and text is not null and lang is not null")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sizes = stash(usable.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = usable.select("doc_id", "lang").filter(F.xxhash64("doc_id") <= _below(F.lit(total), rows))
    if total > 4 * rows and first.count() < rows:
        first = usable.select("doc_id", "lang")
    over_all = first.orderBy(*order, "lang").limit(rows)
    below = _below(F.col("n"), each)
    near = usable.select("doc_id", "lang").join(F.broadcast(sizes.select("lang", below.alias("below"))), "lang").filter(F.xxhash64("doc_id") <= F.col("below"))
    near = stash(near.select("doc_id", "lang").distinct(), "near")
    enough = sizes.filter(F.col("n") > 4 * each).join(near.groupBy("lang").count(), "lang", "left")
    if enough.filter(F.coalesce("count", F.lit(0)) < each).limit(1).count():  # few ids that repeat often
        near = usable.select("doc_id", "lang").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ids = over_all.unionByName(near.withColumn("place", place).filter(F.col("place") <= each).drop("place")).distinct()
    texts = usable.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    one = texts.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    got = sorted(one.select("t.h", "lang", "doc_id", "t.text").collect())  # at most rows + each * languages
    return [r["text"] for r in got], [r["lang"] for r in got]


class Scorer:
    """Predictions for texts, with the scores of words seen kept, up to a bound of words and of their characters."""

    def __init__(self, model: Model | None, keep: int = 200_000, keep_chars: int = 8_000_000):
        self.model, self.keep, self.keep_chars, self.at, self.chars = model, keep, keep_chars, {}, 0
        self.table = np.zeros((0, len(model.langs) if model else 0))

    def _grow(self, new: list[str]) -> None:
        got = self.model.word_scores(new)
        n = len(self.at)
        if n + len(new) > len(self.table):
            bigger = np.zeros((2 * (n + len(new)), got.shape[1]))
            bigger[:n] = self.table[:n]
            self.table = bigger
        self.table[n : n + len(new)] = got
        self.at.update(zip(new, range(n, n + len(new)), strict=True))
        self.chars += sum(map(len, new))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model:
            return [("und", 0.0)] * len(texts)
        if len(self.at) > self.keep or self.chars > self.keep_chars:
            self.at.clear()
            self.chars = 0
        split = [words_of(t) if t else [] for t in texts]
        new = {w for x in split for w in x if w not in self.at}
        if new:
            self._grow(list(new))
        at, out = self.at, []
        for x in split:
            if not any(c.isalpha() for w in x for c in w):  # words may hold other numerals than digits
                out.append(("und", 0.0))
                continue
            total = self.table[np.fromiter(map(at.__getitem__, x), np.int64, len(x))].sum(0)
            best = int(total.argmax())
            out.append((self.model.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def identify(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs without text, with the prediction and its posterior."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, f"{names[0]} string, {names[1]} double", lambda: Scorer(held.value), text)


def keep_known(docs: DataFrame, model: Model | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that have a language, of a posterior of at least `least`, with all their columns.

    Without a model there is no language to miss: only texts without a letter go.
    """
    if model is None:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def known():
        own = Scorer(held.value)
        return lambda column: pa.array([lang != "und" and score >= least for block in text_blocks(column) for lang, score in own(block)], pa.bool_())

    return docs.filter(text_column(docs.sparkSession, BooleanType(), known)(F.col(text).cast("string")))
