"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct words of a batch lie end to end in one array of symbols. In each round every word finds the least rank of
its adjacent pairs (one segmented minimum), merges the leftmost, non-overlapping places of that pair at once, and the
array is compacted; words without a pair that merges leave it. Merging all places at once equals merging one at a time
unless a merge makes a pair of a lower rank; words where it does merge their leftmost place only in that round.

Words are cut before spaces, and long ones between characters that no piece has side by side, which no merge can cross.
Runs of spaces merge by pieces of equal, lowest score, hence after everything else and from the left: a stack folds them.
A symbol that is no piece falls back to its UTF-8 bytes. Supported are models like the public one: BPE with byte
fallback, the identity normaliser, a dummy prefix, white space kept; others raise ValueError.

Defined cases: null and empty text have no ids and decode to the empty text; texts are handled whole, of any length;
of pairs of equal rank the leftmost merges first; repeated rows are rows of their own; an empty table gives an empty
result; extra columns pass through, whatever their names, but for those that have the name of a result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import map_texts, with_workers

SPACE = "▁"
FAR = np.int32(1 << 30)


class PairTable:
    """From pairs of symbols to the rank of their merge and what it makes: open hashing, so that one lookup takes few gathers."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        """pairs: from left << 20 | right to (rank, symbol)."""
        keys = np.array(list(pairs), np.int64)
        self.none = len(keys)
        self.ranks = np.array([*(r for r, _ in pairs.values()), FAR], np.int32)
        self.merged = np.array([*(i for _, i in pairs.values()), -1], np.int32)
        self.bits = max(10, int(4 * len(keys)).bit_length())
        self.keys, self.places = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int32)
        todo, at = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[slots], self.places[slots] = keys[todo[won]], todo[won]
            left = np.delete(np.arange(len(todo)), won)
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair, `none` for those that don't merge."""
        want = np.where((left >= 0) & (right >= 0), left.astype(np.int64) << 20 | right, -2)
        at = self._slots(want)
        found = self.keys[at]
        out = np.where(found == want, self.places[at], np.int32(self.none))
        left_open = np.flatnonzero((found != want) & (found >= 0))
        at = at[left_open]
        while len(left_open):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.keys[at]
            hit = found == want[left_open]
            out[left_open[hit]] = self.places[at[hit]]
            more = ~hit & (found >= 0)
            left_open, at = left_open[more], at[more]
        return out


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n, t = proto.normalizer_spec, proto.trainer_spec
        if t.model_type != 2 or not t.byte_fallback or n.name != "identity" or not n.add_dummy_prefix or n.remove_extra_whitespaces or t.treat_whitespace_as_suffix:
            raise ValueError("only byte-fallback BPE with the identity normaliser and a dummy prefix is supported")
        kinds = {k: [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == k] for k in {p.type for p in proto.pieces}}
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces are not supported")
        normal, self.unk = kinds[1], t.unk_surface
        self.byte_id = {int(p[3:5], 16): i for i, p, _ in kinds[6]}
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.id_of = {p: i for i, p, _ in normal}
        self.text_of = [b""] * len(proto.pieces)
        for i, p, _ in normal:
            self.text_of[i] = p.encode()
        for i, b in self.bytes_of.items():
            self.text_of[i] = b
        self.text_of[t.unk_id] = self.unk.encode()
        self.text_bytes = np.array(self.text_of, object)
        self.is_byte = np.zeros(len(proto.pieces), bool)
        self.is_byte[list(self.bytes_of)] = True
        # Symbols: pieces by their id; characters that are only parts of pieces get ids of their own beyond those.
        self.symbol = dict(self.id_of)
        for _, p, _ in normal:
            for c in p:
                self.symbol.setdefault(c, len(proto.pieces) + len(self.symbol))
        self.spaces = {len(p) for _, p, _ in normal if not p.strip(SPACE)}
        self.inner = {p[k : k + 2] for _, p, _ in normal for k in range(len(p) - 1)}
        if any(x[1] == SPACE and x[0] != SPACE for x in self.inner):
            raise ValueError("pieces that go on after a space are not supported")
        scores = sorted({s for _, p, s in normal if len(p) > 1 and p.strip(SPACE)}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for i, p, s in normal:
            if p.strip(SPACE):
                for k in range(1, len(p)):
                    if p[:k] in self.symbol and p[k:] in self.symbol:
                        pairs[self.symbol[p[:k]] << 20 | self.symbol[p[k:]]] = (rank[s], i)
        self.pairs = PairTable(pairs)
        #: The symbol of each character; -1 - code point for one outside the vocabulary.
        self.symbol_of_char = -1 - np.arange(0x110000, dtype=np.int32)
        self.char_of_symbol: dict[int, str] = {}
        for c, k in self.symbol.items():
            if len(c) == 1:
                self.symbol_of_char[ord(c)] = k
                self.char_of_symbol[k] = c
        self.texts = [str(i) for i in range(len(proto.pieces))]

    # ------------------------------------------------------------ merge rounds

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of all words end to end, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbol_of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        sizes = sizes[sizes > 0]
        place = np.full(len(sym), self.pairs.none, np.int32)
        if len(sym):
            place[:-1] = self.pairs(sym[:-1], sym[1:])
            place[np.cumsum(sizes) - 1] = self.pairs.none
        ended = [(word[:0], sym[:0])]
        while len(sym):
            rank = self.pairs.ranks[place]
            least = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            done = least == FAR
            if done.any():
                gone = np.repeat(done, sizes)
                ended.append((word[gone], sym[gone]))
                stay = np.flatnonzero(~gone)
                sym, word, place, rank, least, sizes = sym[stay], word[stay], place[stay], rank[stay], least[~done], sizes[~done]
                if not len(sym):
                    break
            low = np.repeat(least, sizes)
            at = np.flatnonzero(rank == low)
            # Of places that overlap, a run of neighbours, every other one from the left.
            nth = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.append(True, np.diff(at) != 1), nth, 0))
            at = at[(nth - run) % 2 == 0]
            after, kept, fresh = self._apply(sym, word, place, at)
            late = self.pairs.ranks[after[2][fresh]] <= low[kept[fresh]]
            if late.any():
                slow = np.isin(word[at], after[1][fresh[late]])
                at = at[~slow | np.append(True, word[at[1:]] != word[at[:-1]])]
                after, _, _ = self._apply(sym, word, place, at)
            sizes = sizes - np.bincount(np.cumsum(np.append(0, word[1:] != word[:-1]))[at], minlength=len(sizes))
            sym, word, place = after
        word, sym = (np.concatenate(x) for x in zip(*ended, strict=True))
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _apply(self, sym: np.ndarray, word: np.ndarray, place: np.ndarray, at: np.ndarray):
        """The arrays once the pairs at `at` have merged, the old place of each symbol left, and the new places whose pair is new."""
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        kept = np.flatnonzero(stay)
        grown = at - np.arange(len(at))
        sym2, word2, place2 = sym[kept], word[kept], place[kept]
        sym2[grown] = self.pairs.merged[place[at]]
        fresh = np.concatenate([grown, grown[grown > 0] - 1])
        right = np.minimum(fresh + 1, len(sym2) - 1)
        place2[fresh] = np.where((right > fresh) & (word2[right] == word2[fresh]), self.pairs(sym2[fresh], sym2[right]), self.pairs.none)
        return (sym2, word2, place2), kept, fresh

    # ------------------------------------------------------------ texts

    def fold_spaces(self, n: int) -> list[int]:
        """n spaces, merged from the left."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-1] + stack[-2] in self.spaces:
                stack[-2:] = [stack[-1] + stack[-2]]
        return [self.id_of[SPACE * k] for k in stack]

    def _cuts(self, word: str) -> list[str]:
        """A long word in parts that no merge can cross."""
        at = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.inner), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _pool(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each with a space in front, end to end, and how many each has."""
        parts, first = [], np.arange(len(words))
        long = [k for k, w in enumerate(words) if len(w) > 31]
        if long:
            cut = {k: self._cuts(SPACE + words[k]) for k in long}
            parts = [p for k, w in enumerate(words) for p in cut.get(k, (SPACE + w,))]
            many = np.ones(len(words), np.int64)
            many[long] = [len(cut[k]) for k in long]
            first = np.cumsum(many) - many
        sym, sizes = self.merge_words(parts or [SPACE + w for w in words])
        odd = np.flatnonzero((sym < 0) | (sym >= len(self.text_of)))
        if len(odd):  # no pieces: their bytes
            kinds, which = np.unique(sym[odd], return_inverse=True)
            spelt = [[self.byte_id[b] for b in (chr(-1 - k) if k < 0 else self.char_of_symbol[k]).encode()] for k in kinds.tolist()]
            width = np.ones(len(sym), np.int64)
            width[odd] = np.array([len(x) for x in spelt])[which]
            ends = np.append(0, np.cumsum(width))
            sizes = np.diff(ends[np.append(0, np.cumsum(sizes))])
            out = np.repeat(sym, width)
            for k, x in enumerate(spelt):
                for j, own in enumerate(x):
                    out[ends[odd[which == k]] + j] = own
            sym = out
        return sym, np.add.reduceat(sizes, first) if len(first) else sizes

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the len + 1 offsets of the texts."""
        index: dict[str, int] = {"": 0}
        flat: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                own = t.replace(SPACE, " ").split(" ")
                counts[k] = len(own)
                flat += [index.setdefault(w, len(index)) for w in own]
        which = np.array(flat, np.int64)
        if not len(which):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        pool, sizes = self._pool(list(index))
        begin = (np.cumsum(sizes) - sizes)[which]
        length = sizes[which]
        blank = np.flatnonzero(which == 0)
        if len(blank):
            # A space more before a word joins its first one, where that has stayed alone; else the run is folded by itself.
            rows = np.append(0, np.cumsum(counts))
            first = blank[np.append(True, np.diff(blank) != 1) | np.isin(blank, rows)]
            ends = blank[np.append(np.flatnonzero(np.diff(blank) != 1), len(blank) - 1)]
            ends = np.minimum(ends[np.searchsorted(ends, first)] + 1, rows[np.searchsorted(rows, first, "right")])
            run = ends - first
            near = np.minimum(ends, len(which) - 1)
            alone = ~np.isin(ends, rows) & (pool[begin[near]] == self.id_of[SPACE])
            begin[near[alone]] += 1
            length[near[alone]] -= 1
            length[blank] = 0
            kinds, back = np.unique(run + alone, return_inverse=True)
            folded = [self.fold_spaces(n) for n in kinds.tolist()]
            size = np.array([len(x) for x in folded])
            begin[first] = (len(pool) + np.cumsum(size) - size)[back]
            length[first] = size[back]
            pool = np.concatenate([pool, *(np.array(x, np.int32) for x in folded)])
        ends = np.append(0, np.cumsum(length))
        ids = pool[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])]
        return ids, ends[np.append(0, np.cumsum(counts))]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, at = self.encode_flat(texts)
        at = at.tolist()
        return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the dummy prefix; a byte that is part of no character becomes U+FFFD."""
        table = self.text_of
        raw = b"".join([table[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._loose(ids)
        text = text.replace(SPACE, " ")
        first = next((table[i] for i in ids if table[i]), b"")  # control pieces have no text
        return text[1:] if first.startswith(SPACE.encode()) else text

    def _loose(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.text_of[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                out.append(self.text_of[i].decode())
        return "".join(out)


@functools.lru_cache(2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


# ------------------------------------------------------------ columns


def map_ids(df: DataFrame, path: str, fields: str, make, text: str = "text") -> DataFrame:
    """df's columns but text, and what make(model, ids) returns for each text's ids under `fields` (a schema)."""
    return map_texts(df, fields, lambda: lambda texts: [make(model(path), ids) for ids in model(path).encode(texts)], text)


def encode_column(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df without text, with ids (array of int)."""
    return map_ids(df, path, "ids array<int>", lambda m, ids: (ids,), text)


def decode_column(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with `decoded`, the text of ids; null ids are none."""
    with_workers(df.sparkSession)

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        own = model(path)
        return column.map(lambda x: own.decode(list(x) if x is not None else []))

    return df.withColumn("decoded", decoded(F.col(ids)))


def digests(own: PieceModel, ids: list[int]) -> tuple[int, str, str]:
    """How many ids, and SHA-256 of their decimals and of their decoded text."""
    table = own.texts
    return len(ids), hashlib.sha256(",".join([table[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()
