"""Many words at once: an Aho-Corasick automaton built of transition tables in numpy, walked over all texts of a batch together.

A word's letters are paths in a trie; a state's failure link leads to the longest suffix of its path that is a path as
well. With links resolved into the table, a text costs one step per byte whatever the number of words. All texts of a
batch, long ones in stretches, step together, so a step is one look-up in the table for as many as are still being read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import text_of

#: Words of one automaton; more words are cut into several, each a pass of its own over the texts.
WORDS = 20_000
#: Bytes of a text that are read one after another.
STRETCH = 4096


class Automaton:
    """States by bytes. ends[s] is the word that ends in s, or -1; up[s] the next state on s's failure path where one ends, or 0."""

    def __init__(self, words: list[bytes]):
        used = np.unique(np.frombuffer(b"".join(words), np.uint8)) if words else np.zeros(0, np.uint8)
        self.longest = max(map(len, words), default=1)
        self.letter = np.zeros(256, np.int64)  # 0 is any byte that no word has
        self.letter[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, word in enumerate(words):
            at = 0
            for c in self.letter[np.frombuffer(word, np.uint8)].tolist():
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][c]
            ends[at] = i
        self.ends, self.up = np.array(ends, np.int64), np.zeros(len(children), np.int64)
        self.table = np.zeros((len(children), len(used) + 1), np.int32)
        fail, level = np.zeros(len(children), np.int64), [0]
        while level:  # breadth first, so that a state's failure link is complete before the state
            deeper = []
            for at in level:
                row = self.table[fail[at]].copy() if at else self.table[0]
                for c, child in children[at].items():
                    fail[child] = row[c] if at else 0
                    row[c] = child
                    deeper.append(child)
                self.table[at] = row
                self.up[at] = fail[at] if self.ends[fail[at]] >= 0 else self.up[fail[at]]
            level = deeper
        self.says = (self.ends >= 0) | (self.up > 0)

    def find(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) of each word that a text holds, once or more often; texts are data between offs."""
        # Long texts are read in stretches that overlap by all but a byte of the longest word, so that steps stay few.
        stretches = np.maximum(1, -(-np.diff(offs) // STRETCH))
        own = np.repeat(np.arange(len(stretches)), stretches)
        begin = offs[own] + STRETCH * (np.arange(len(own)) - np.repeat(np.cumsum(stretches) - stretches, stretches))
        sizes = np.minimum(STRETCH + self.longest - 1, offs[own + 1] - begin)
        order = np.argsort(-sizes, kind="stable")
        begin, n, own = begin[order], sizes[order], own[order]
        state, hits = np.zeros(len(n), np.int64), []
        for step in range(int(n[0]) if len(n) else 0):
            live = np.searchsorted(-n, -step, "left")  # texts are ordered by length: those still read come first
            state[:live] = self.table[state[:live], self.letter[data[begin[:live] + step]]]
            text = np.flatnonzero(self.says[state[:live]])
            if len(text):
                hits.append(np.stack([own[text], state[text]]))
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, at = np.unique(np.concatenate(hits, 1), axis=1)
        out = []
        while len(at):
            mine = self.ends[at] >= 0
            out.append(np.stack([text[mine], self.ends[at[mine]]]))
            text, at = text[self.up[at] > 0], self.up[at[self.up[at] > 0]]
        return tuple(np.unique(np.concatenate(out, 1), axis=1))


def first_holding(docs: DataFrame, words: DataFrame, key: str, text: str = "text", most_words: int = 1_000_000) -> DataFrame:
    """(the columns of words but word, key): for each group of words the least key of a row whose text, in lower case, holds any of them.

    words: (…, word), groups told by its other columns; an empty or null word is in nothing, and groups that are found
    nowhere are left out. The distinct words go to all tasks in automata of WORDS words, so there may be most_words of
    them; each task reports, for each word it finds, its least key, and only those meet. Null keys and texts hold nothing.
    """
    group = [c for c in words.columns if c != "word"]
    asked = words.filter("word <> ''").withColumn("word", F.lower("word"))
    distinct = sorted(r[0].encode() for r in asked.select("word").distinct().limit(most_words + 1).collect())
    if len(distinct) > most_words:
        raise ValueError(f"more than {most_words} words")
    kind = dict(docs.dtypes)[key]
    if not distinct:
        return words.sparkSession.createDataFrame([], asked.select(*group).schema.add(key, docs.schema[key].dataType))
    held = docs.sparkSession.sparkContext.broadcast(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        automata = [(at, Automaton(own[at : at + WORDS])) for at in range(0, len(own), WORDS)]
        least: dict[int, object] = {}
        for batch in batches:
            keys, column = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
            _, offsets, data = column.buffers()
            offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            for at, automaton in automata:
                for row, word in zip(*(x.tolist() for x in automaton.find(raw, offs)), strict=True):
                    if keys[row] is not None and (at + word not in least or keys[row] < least[at + word]):
                        least[at + word] = keys[row]
        yield pa.RecordBatch.from_arrays([pa.array([own[w].decode() for w in least], pa.string()), pa.array(list(least.values()), batch_kind)], names=["word", "found"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_kind = to_arrow_type(docs.schema[key].dataType)
    found = docs.select(F.col(key), F.lower(text_of(F.col(text))).alias("text")).mapInArrow(run, f"word string, found {kind}")
    firsts = found.groupBy("word").agg(F.min("found").alias("found"))
    return asked.join(firsts, "word").groupBy(*group).agg(F.min("found").alias(key))
