"""Bounded-space online packing.

Each partition tokenises its documents and keeps `windows` sequences open. A piece goes where it leaves the least room
(best fit). When none fits, the fullest window is topped up with the head of the piece where that saves at least
`min_cut` tokens, and emitted; the rest goes on as a piece of its own. What is open at a partition's end is merged
afterwards: open windows of `merge_width` neighbouring partitions are packed, whole, into common sequences by the same
rule. State is bounded by windows * max_tokens ids per partition, whatever the partition's size.

Token ids are those of the byte-level BPE named by its file: the rank file of the same vocabulary encodes plain text,
and a text that holds one of the special strings goes through the tokenizer itself, which treats them as it does.

Defined cases: null text is empty, and a document always has its end id; texts of any length are cut into pieces that
together hold each id once; repeated rows are documents of their own; of windows with equal room the first opened is
taken; an empty table gives an empty result; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import bisect
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import new_path, with_workers

#: The plain encoder's pattern matcher goes as deep as a run of white space is long; longer runs go through the tokenizer.
DEEP = 100_000


@functools.lru_cache(1)
def _encoders(tokenizer: str, ranks: str, pattern: str):
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = Tokenizer.from_file(tokenizer)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={}), whole, special


def encode(text: str, tokenizer: str, ranks: str, pattern: str) -> np.ndarray:
    """Token ids of a text, as the tokenizer gives them without added tokens."""
    plain, whole, special = _encoders(tokenizer, ranks, pattern)
    deep = len(text) > DEEP and any(m.end() - m.start() > DEEP for m in re.finditer(r"\s+", text))
    if deep or any(s in text for s in special):
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(plain.encode_ordinary(text), np.uint32)


class Packer:
    """Open windows of at most `size` tokens; a piece is any tuple with its length last."""

    def __init__(self, size: int, windows: int, min_cut: int | None):
        self.size, self.windows, self.min_cut = size, windows, min_cut
        self.room: list[tuple[int, int]] = []  # (room left, window id), sorted
        self.held: dict[int, list] = {}
        self.next = 0

    def add(self, item, length: int, cut) -> Iterator[tuple[int, list]]:
        """Places an item; yields the windows that close. cut(item, n) splits off its first n tokens."""
        while length:
            if length == self.size:
                yield self._fresh(), [item]
                return
            at = bisect.bisect_left(self.room, (length, -1))
            if at < len(self.room):
                left, key = self.room.pop(at)
                self.held[key].append(item)
                if left == length:
                    yield key, self.held.pop(key)
                else:
                    bisect.insort(self.room, (left - length, key))
                return
            if len(self.room) < self.windows:
                key = self._fresh()
                self.held[key] = [item]
                bisect.insort(self.room, (self.size - length, key))
                return
            left, key = self.room.pop(0)  # the fullest
            if self.min_cut and left >= self.min_cut:
                head, item = cut(item, left)
                self.held[key].append(head)
                length -= left
            yield key, self.held.pop(key)

    def _fresh(self) -> int:
        self.next += 1
        return self.next - 1


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint, seq bigint, offset bigint, open boolean"


def pack(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", max_tokens: int = 1024, end_id: int = 0, windows: int = 32, min_cut: int = 8, merge_width: int = 64) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer = TaskContext.get().partitionId(), Packer(max_tokens, windows, min_cut)
        out: list[tuple] = []

        def close(key: int, items: list, still_open: bool) -> None:
            offset = 0
            for doc, start, ids, total in items:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, part, key, offset, still_open))
                offset += len(ids)

        def cut(item, n):
            doc, start, ids, total = item
            return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)

        def flush():
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in PIECES.split(", ")])
            out.clear()
            return pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(words.as_py() or "", tokenizer, ranks, pattern), np.uint32(end_id))
                for at in range(0, len(ids), max_tokens):
                    piece = ids[at : at + max_tokens]
                    for key, items in packer.add((doc, at, piece, len(ids)), len(piece), cut):
                        close(key, items, False)
                if len(out) > 5000:
                    yield flush()
        for key, items in packer.held.items():
            close(key, items, True)
        if out:
            yield flush()

    kinds = {"bigint": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in PIECES.split(", ")])
    spark, path = with_workers(docs.sparkSession), new_path(docs.sparkSession, "pieces")
    # Kept apart by whether their window is still open: only those, at most `windows` a partition, are read again to merge.
    docs.select(F.col(doc_id).cast("bigint"), text).mapInArrow(partition, PIECES).write.partitionBy("open").parquet(path)
    pieces = spark.read.schema(PIECES).parquet(path)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        packer, rows = Packer(max_tokens, windows, None), []

        def close(key, items):
            offset = 0
            for part, seq, n in items:
                rows.append((part, seq, key, offset))
                offset += n

        group = group.sort_values(["tokens", "part", "seq"], ascending=[False, True, True])
        for part, seq, n in zip(group["part"], group["seq"], group["tokens"], strict=True):
            for key, items in packer.add((part, seq, n), n, None):
                close(key, items)
        for key, items in packer.held.items():
            close(key, items)
        return pd.DataFrame(rows, columns=["part", "seq", "new_seq", "shift"]).astype("int64")

    left = pieces.filter("open")
    totals = left.groupBy("part", "seq").agg(F.sum("length").alias("tokens")).withColumn("band", F.floor(F.col("part") / merge_width))
    merged = totals.groupBy("band").applyInPandas(merge, "part bigint, seq bigint, new_seq bigint, shift bigint")
    high = F.lit(1 << 30)
    bound = left.join(merged, ["part", "seq"]).withColumn("sequence_id", F.shiftleft(high + F.floor(F.col("part") / merge_width), 32) + F.col("new_seq")).withColumn("offset", F.col("offset") + F.col("shift"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    closed = pieces.filter("not open").withColumn("sequence_id", F.shiftleft("part", 32) + F.col("seq"))
    return closed.select(names).unionByName(bound.select(names))
