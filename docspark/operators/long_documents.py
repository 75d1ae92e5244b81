"""Markdown, sections and chunks of documents that are too long for one row.

A document's blocks are cut into buckets of BUCKET block numbers. What a block needs of those before it (the page before,
the number of sections so far, the last heading) is a prefix scan of two levels: windows within a bucket, one row of
totals for each bucket, a window over those rows, and a join back by the key that the buckets are already dealt by. So
a document of any length is spread over all tasks, and no group holds more than a bucket. Joins are by KEY, which is never
null, since a null-safe one would deal all lines anew. Documents of one bucket, of CHARS characters at most, have nothing
before it: their lines are dealt once, and sections and chunks are made where they lie.

Chunks are packed greedily, each from where the one before ended. Which paragraph begins a chunk hangs on lengths alone,
so a bucket of paragraphs is a function from the length it begins with to the one it ends with; ways from different
beginnings soon fall together, and the function has few steps. Buckets are composed in order, and then each of them is
packed by itself. Sections of up to `whole` characters, and those of documents of one bucket, are packed as one row;
results are the same either way.

Defined cases: as markdown.build and chunking.chunk_markdown have them, whose results these are. In sections beyond
`whole` a page mark has to stand on one line. A line, a paragraph and a chunk have to fit into a row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import strip
from docspark.operators import chunking, markdown
from docspark.plans.shared import stash

#: Block numbers, and paragraphs, of a bucket.
BUCKET, PARAGRAPHS = 4096, 1024
#: What a document of one bucket may have and still be taken as one.
CHARS = 1 << 26
#: A document's id as text, another one for null.
KEY = "__doc"


def _keyed(blocks: DataFrame, source: Column | None) -> DataFrame:
    doc = F.col("doc_id")
    title = source if source is not None else doc.cast("string")
    key = F.when(doc.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), doc.cast("string")))
    return blocks.withColumns({KEY: key, "bucket": F.floor(F.col("block_no") / BUCKET), "__title": title})


def _by_length(blocks: DataFrame, source: Column | None) -> list[tuple[DataFrame, bool]]:
    """Blocks with KEY and bucket: those of documents of one bucket, and, where there are any, those of longer ones."""
    rows = _keyed(blocks, source)
    spans = rows.groupBy(KEY).agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.sum(F.length("text")).alias("chars"))
    longer = stash(spans.filter((F.col("low") < F.col("high")) | (F.col("chars") > CHARS)).select(KEY), "longer")
    if longer.isEmpty():
        return [(rows, False)]
    return [(rows.join(longer, KEY, "left_anti"), False), (rows.join(longer, KEY, "left_semi"), True)]


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _carried(rows: DataFrame, keys: list[str], totals: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """rows (with keys and bucket) beside `before`: windows over each key's buckets of `totals`, one row for each bucket."""
    over = rows.groupBy(*keys, "bucket").agg(*(c.alias(n) for n, c in totals.items()))
    return rows.join(over.select(*keys, "bucket", *(c.alias(n) for n, c in before.items())), [*keys, "bucket"])


def previous(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, carry: bool = True) -> DataFrame:
    """Adds name, a struct with `value` of the row before among those of equal keys, which are not null; null for the first
    one. Without carry, keys have one bucket each."""
    held = rows.withColumn("__value", F.struct(value.alias("value")))
    local = F.lag("__value").over(Window.partitionBy(*keys, "bucket").orderBy(*order))
    if not carry:
        return held.withColumn(name, local).drop("__value")
    joined = _carried(held.withColumn("__local", local), keys, {"last": F.max_by("__value", F.struct(*order))}, {"__before": F.lag("last").over(Window.partitionBy(*keys).orderBy("bucket"))})
    return joined.withColumn(name, F.coalesce("__local", "__before")).drop("__value", "__local", "__before")


def running(rows: DataFrame, keys: list[str], order: list[str], counted: Column, latest: Column, count: str, last: str, carry: bool = True) -> DataFrame:
    """Adds count, how often `counted` has held so far, and last, the last `latest` that was not null, this row included."""
    upto = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not carry:
        return rows.withColumns({count: F.sum(counted.cast("bigint")).over(upto), last: F.last(latest, True).over(upto)})
    held = rows.withColumns({"__n": counted.cast("bigint"), "__latest": latest})
    local = held.withColumns({"__count": F.sum("__n").over(upto), "__last": F.last("__latest", True).over(upto)})
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = {"n": F.sum("__n"), "latest": F.max_by("__latest", F.when(F.col("__latest").isNotNull(), F.struct(*order)))}
    joined = _carried(local, keys, totals, {"__before": F.sum("n").over(earlier), "__earlier": F.last("latest", True).over(earlier)})
    found = {count: F.col("__count") + F.coalesce("__before", F.lit(0)), last: F.coalesce("__last", "__earlier")}
    return joined.withColumns(found).drop("__n", "__latest", "__count", "__last", "__before", "__earlier")


def _lines(rows: DataFrame, carry: bool) -> DataFrame:
    own = {c: F.col(c) if c in rows.columns else None for c in ("chart", "image")}
    rows = previous(rows, [KEY], ["block_no"], F.col("page_num"), "__page", carry)
    body = markdown.block_lines(F.col("block_type"), F.col("text"), F.col("page_num"), **own)
    none = F.array().cast(markdown.LINES)
    mark = F.when(F.col("page_num").eqNullSafe(F.col("__page.value")), none).otherwise(
        F.array(F.lit(""), F.lit("---"), F.concat(F.lit("*Страница "), F.coalesce(F.col("page_num").cast("string"), F.lit("None")), F.lit("*")), F.lit(""))
    )
    head = F.when(F.col("__page").isNull(), F.array(F.concat(F.lit("# "), F.col("__title")), F.lit(""))).otherwise(none)
    each = F.concat(head, mark, F.flatten(F.transform(body, lambda x: F.split(x, "\n"))))
    return rows.select(KEY, "doc_id", "block_no", "bucket", F.posexplode(each).alias("k", "line")).filter("line is not null")


def _section_lines(rows: DataFrame, carry: bool) -> DataFrame:
    order = ["block_no", "k"]
    rows = _lines(rows, carry).withColumn("head", F.col("line").rlike(chunking.HEADING))
    rows = previous(rows, [KEY], order, F.col("head"), "__above", carry)
    opens = ~F.col("head") & (F.col("__above").isNull() | F.col("__above.value"))
    name = F.when(F.col("head"), strip(F.regexp_extract("line", chunking.HEADING, 2)))
    rows = running(rows, [KEY], order, opens, name, "section_no", "title", carry).filter("not head")
    return rows.select(KEY, "doc_id", (F.col("section_no") - 1).cast("int").alias("section_no"), F.coalesce("title", F.lit(chunking.NO_TITLE)).alias("title"), *order, "line", "bucket")


def lines(blocks: DataFrame, source: Column | None = None) -> DataFrame:
    """(doc_id, block_no, k, line, bucket): the lines of markdown.build, a row each, in order of block_no and k."""
    return _all([_lines(*part) for part in _by_length(blocks, source)]).drop(KEY)


def section_lines(blocks: DataFrame, source: Column | None = None) -> DataFrame:
    """(doc_id, section_no, title, block_no, k, line, bucket): the lines that belong to a section; numbers count sections with a line."""
    return _all([_section_lines(*part) for part in _by_length(blocks, source)]).drop(KEY)


def _described(rows: DataFrame, carry: bool) -> DataFrame:
    """A row for each section: KEY, title, length, page, type."""
    line = F.col("line")
    narrow = rows.select(KEY, "doc_id", "bucket", "section_no", "title", "block_no", "k", F.length(line).alias("n"), chunking.page_number(line).alias("page"), chunking.is_table(line).alias("drawn"), chunking.is_image(line).alias("shown"))
    return narrow.groupBy(KEY, *([] if carry else ["bucket"]), "section_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("title").alias("title"),
        (F.sum(F.col("n") + 1) - 1).alias("length"),
        F.min_by("page", F.when(F.col("page").isNotNull(), F.struct("block_no", "k"))).alias("page"),
        F.when(F.bool_or("drawn"), "table").when(F.bool_or("shown"), "image_caption").otherwise("text").alias("type"),
    )


def _joined(column: str, *order: str, gap: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, column))), lambda x: x[column]), gap)


def step(state: np.ndarray, n: int, pieces: int, tail: int, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths after, chunks closed) of packing a paragraph of n characters to chunks of the lengths in state, 0 if none
    is open. pieces and tail are its sentences' packs and the last one's length, where it may be split."""
    over = state + n + 2 > most
    carried = np.minimum(state, overlap) + 2 + n if overlap > 0 else np.full(len(state), n)
    after = np.where(over, np.where(state > 0, carried, tail), np.where(state > 0, state + 2 + n, n))
    closed = np.where(over, np.where(state > 0, 1, pieces - 1), 0)
    return np.minimum(after, most), closed  # beyond most all are alike


def _function(paragraphs: list[dict], most: int, overlap: int) -> list[list[int]]:
    """[from, after, closed] of a bucket, a row where a run of beginnings with one outcome starts."""
    state, index, closed = np.arange(most + 1), np.arange(most + 1), np.zeros(most + 1, np.int64)
    for p in paragraphs:
        after, now = step(state, p["n"], p["pieces"], p["tail"], most, overlap)
        closed += now[index]
        state, back = np.unique(after, return_inverse=True)
        index = back[index]
    ends = state[index]
    new = np.r_[True, (ends[1:] != ends[:-1]) | (closed[1:] != closed[:-1])]
    return np.stack([np.flatnonzero(new), ends[new], closed[new]], 1).tolist()


def _packed(paragraphs: DataFrame, most: int, overlap: int) -> DataFrame:
    """(KEY, section_no, chunk_no, carried, own): chunks of (KEY, section_no, no, text), without what they carry over."""
    split = F.when(F.length("text") + 2 > most, chunking.sentences(F.col("text"), most))
    rows = stash(paragraphs.withColumn("pieces", split).withColumn("bucket", F.floor(F.col("no") / PARAGRAPHS)), "paragraphs")
    key = [KEY, "section_no"]
    sizes = F.struct("no", F.length("text").alias("n"), F.coalesce(F.size("pieces"), F.lit(1)).alias("pieces"), F.coalesce(F.length(F.element_at("pieces", -1)), F.lit(0)).alias("tail"))

    def functions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(runs=[_function(x, most, overlap) for x in frame["sizes"]])[[*key, "bucket", "runs"]]

    def composed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, section, buckets in frame[[*key, "buckets"]].itertuples(index=False):
                state = done = 0
                out = []
                for b in buckets:
                    out.append((doc, section, b["bucket"], state, done))
                    runs = np.stack(b["runs"])
                    _, state, closed = runs[np.searchsorted(runs[:, 0], state, "right") - 1].tolist()
                    done += closed
                yield pd.DataFrame(out, columns=[*key, "bucket", "state", "done"])

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, section, state, chunk, held in frame[[*key, "state", "done", "held"]].itertuples(index=False):
                for p in held:
                    n, pieces = len(p["text"]), p["pieces"]
                    after, closed = step(np.array([state]), n, 1 if pieces is None else len(pieces), 0 if pieces is None else len(pieces[-1]), most, overlap)
                    if state == 0 and n + 2 > most:
                        out += [(doc, section, chunk + i, p["no"], False, x) for i, x in enumerate(pieces)]
                    else:
                        out.append((doc, section, chunk + int(closed[0]), p["no"], bool(closed[0]) and overlap > 0, p["text"]))
                    state, chunk = int(after[0]), chunk + int(closed[0])
            yield pd.DataFrame(out, columns=[*key, "chunk_no", "no", "carried", "text"])

    sized = rows.groupBy(*key, "bucket").agg(F.array_sort(F.collect_list(sizes)).alias("sizes"))
    runs = sized.mapInPandas(functions, f"{KEY} string, section_no int, bucket bigint, runs array<array<bigint>>")
    ordered = runs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("bucket", "runs"))).alias("buckets"))
    begins = ordered.mapInPandas(composed, f"{KEY} string, section_no int, bucket bigint, state bigint, done bigint")
    whole = rows.groupBy(*key, "bucket").agg(F.array_sort(F.collect_list(F.struct("no", "text", "pieces"))).alias("held"))
    known = whole.join(begins, [*key, "bucket"])
    dealt = known.mapInPandas(placed, f"{KEY} string, section_no int, chunk_no bigint, no bigint, carried boolean, text string")
    return dealt.groupBy(*key, "chunk_no").agg(F.bool_or("carried").alias("carried"), _joined("text", "no", gap="\n\n").alias("own"))


def _with_overlap(chunks: DataFrame, overlap: int) -> DataFrame:
    """Chunks as they are read: one that is carried over begins with the last `overlap` characters of the one before, which
    may begin with the last ones of the one before that."""
    chunks = stash(chunks, "chunks")
    key = [KEY, "section_no"]

    def earlier(n: int) -> DataFrame:
        tail = F.right("own", F.lit(overlap))
        return chunks.select(*key, (F.col("chunk_no") + n).alias("chunk_no"), tail.alias(f"tail{n}"), F.col("carried").alias(f"carried{n}"))

    out = chunks
    for n in (1, 2):
        out = out.join(earlier(n), [*key, "chunk_no"], "left")
    short = F.col("carried1") & (F.length("tail1") < overlap)
    tail = F.when(short, F.right(F.concat("tail2", F.lit("\n\n"), "tail1"), F.lit(overlap))).otherwise(F.col("tail1"))
    return out.select(*key, "chunk_no", F.when(F.col("carried"), F.concat(tail, F.lit("\n\n"), "own")).otherwise(F.col("own")).alias("raw"))


def sections(blocks: DataFrame, source: Column | None = None) -> DataFrame:
    """(doc_id, section_no, title, page, type, length): chunking.sections of the blocks' Markdown, without bodies."""
    parts = [_described(_section_lines(rows, carry), carry) for rows, carry in _by_length(blocks, source)]
    return _all([p.select("doc_id", "section_no", "title", "length", "page", "type") for p in parts])


def chunk_blocks(blocks: DataFrame, most: int = 1000, overlap: int = 100, least: int = 50, whole: int = 1 << 20, source: Column | None = None) -> DataFrame:
    """The rows of chunking.chunk_markdown, from blocks. Sections of up to `whole` characters are folded in a row, as are
    those of documents of one bucket."""
    if most < 3 * overlap + 6:
        raise ValueError("most has to be 3 * overlap + 6 at least, so that a chunk carries over from two others at most")
    whole = max(whole, most)  # a section that fits into one chunk is that chunk as it is
    made = _all([(_over_buckets(rows, most, overlap, whole) if carry else _in_place(rows, most, overlap)) for rows, carry in _by_length(blocks, source)])
    kept = made.withColumn("text", strip(F.col("raw"))).filter(F.length("text") >= least)
    return kept.select(chunking.chunk_id(F.col("doc_id"), F.col("section_no"), F.col("chunk_no")).alias("chunk_id"), "doc_id", "section_no", "chunk_no", "text", "type", "page", "section")


CHUNK = ["doc_id", "section_no", "section", "page", "type", "chunk_no", "raw"]


def _folded(lines: DataFrame, key: list[str], most: int, overlap: int) -> DataFrame:
    """CHUNK of lines of sections that fit into a row each."""
    bodies = lines.groupBy(*key).agg(_joined("line", "block_no", "k", gap="\n").alias("body"), F.first("title").alias("section"), F.first("doc_id").alias("doc_id"))
    typed = bodies.withColumns({"page": chunking.page_number(F.col("body")), "type": chunking.section_type(F.col("body"))})
    return typed.select("doc_id", "section_no", "section", "page", "type", F.posexplode(chunking.sub_chunks(F.col("body"), most, overlap)).alias("chunk_no", "raw"))


def _in_place(rows: DataFrame, most: int, overlap: int) -> DataFrame:
    """CHUNK of documents of one bucket: lines are dealt by it, and so are their sections."""
    return _folded(_section_lines(rows, False), [KEY, "bucket", "section_no"], most, overlap)


def _over_buckets(rows: DataFrame, most: int, overlap: int, whole: int) -> DataFrame:
    """CHUNK of longer documents."""
    rows = stash(_section_lines(rows, True), "lines")
    about = stash(_described(rows, True), "sections")
    key = [KEY, "section_no"]
    sized = rows.join(about.select(*key, "length"), key)
    folded = _folded(sized.filter(F.col("length") <= whole), key, most, overlap)
    long = sized.filter(F.col("length") > whole).select(*rows.columns)
    order = ["block_no", "k"]
    long = previous(long, key, order, F.col("line") != "", "__full")
    begins = (F.col("line") != "") & (F.col("__full").isNull() | ~F.col("__full.value"))
    long = running(long, key, order, begins, F.lit(None).cast("string"), "no", "__none").filter("line <> ''")
    paragraphs = long.groupBy(*key, "no").agg(strip(_joined("line", *order, gap="\n")).alias("text")).filter("text <> ''")
    packed = _with_overlap(_packed(paragraphs, most, overlap), overlap)
    packed = packed.join(about.select(*key, "doc_id", F.col("title").alias("section"), "page", "type"), key)
    return folded.unionByName(packed.select(*(F.col(c).cast("int") if c == "chunk_no" else c for c in CHUNK)))
