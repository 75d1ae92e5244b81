"""Exact top-k by inner product, with a filter after it, and the assembly of contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.vectors import dot

NOTHING = "Контекст не найден."
BREAK = "\n\n---\n\n"
#: How many queries, and how many rows of the index, are in a block.
QUERY_BLOCK, ROW_BLOCK = 256, 1024


def top_k(index: DataFrame, query: list[float], k: int, key: str = "row_id", filter_type: Column | None = None) -> DataFrame:
    """The k rows of the highest inner product with one query, ties by key.

    With a filter, it is applied to the best 3k, so fewer than k may be left. One TakeOrderedAndProject; no shuffle of rows.
    The query counts over its length, the index's vectors as they are. Rows without a vector, with a null or
    non-finite component or of another dimension than the query are left out.
    """
    length = float(np.linalg.norm(query)) or 1.0
    # Rows without a score come last and go after the limit: asked before it, the vector would be worked out once more.
    score = dot(F.col("vec"), F.array(*[F.lit(float(x) / length) for x in query]))
    scored = index.withColumn("score", score).withColumn("score", F.when(F.abs("score") < float("inf"), F.col("score")))
    best = scored.orderBy(F.desc("score"), key).limit(3 * k if filter_type is not None else k).filter("score is not null")
    return best.filter(filter_type).orderBy(F.desc("score"), key).limit(k) if filter_type is not None else best


def top_k_batch(index: DataFrame, queries: DataFrame, k: int, key: str = "row_id", query_key: str = "query_id") -> DataFrame:
    """(query_key, rank, key, score): for each query (query_key, vec) its k best rows of the index, ties by key.

    Queries are packed into blocks, and rows of the index into blocks; every block of queries meets every block of rows
    as one matrix product, which passes on the k best of each query. So neither queries nor pairs of queries and rows
    are ever rows of the driver, and the plan holds block pairs only. Scores count to 12 decimals, so that equal ones
    tie whatever their block. Queries count over their length, the index's vectors as they are. Rows and queries without a
    vector, or with a null or non-finite component, are left out, and those of different dimensions don't meet.
    """
    blocks_of = lambda df, name, rows, unit: df.select(name, "vec").mapInPandas(_packer(name, rows, unit), "keys binary, dim int, matrix binary")
    asked = blocks_of(queries, query_key, QUERY_BLOCK, True).select(F.col("keys").alias("asked"), F.col("dim").alias("asked_dim"), F.col("matrix").alias("asked_matrix"))
    rows = blocks_of(index, key, ROW_BLOCK, False)
    met = rows.join(asked, F.lit(True))  # a stated set of queries against all rows, in blocks

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for keys, dim, matrix, names, asked_dim, wanted in frame.itertuples(index=False):
                if dim != asked_dim:
                    continue
                names, own = np.frombuffer(names, np.int64), np.frombuffer(keys, np.int64)
                scores = np.round(np.frombuffer(matrix).reshape(-1, dim) @ np.frombuffer(wanted).reshape(-1, dim).T, 12)
                n = min(k, len(own))
                # Rows that tie with the k-th stay, so that ties can be settled by key.
                row, query = np.nonzero(scores >= np.partition(scores, len(own) - n, axis=0)[len(own) - n])
                found = pd.DataFrame({query_key: names[query], key: own[row], "score": scores[row, query]})
                yield found.sort_values([query_key, "score", key], ascending=[True, False, True]).groupby(query_key, sort=False).head(k)

    near = met.select("keys", "dim", "matrix", "asked", "asked_dim", "asked_matrix").mapInPandas(best, f"{query_key} bigint, {key} bigint, score double")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(query_key, "rank", key, "score")


def _packer(name: str, rows: int, unit: bool):
    """(name, vec) to blocks of at most `rows` keys and vectors of one dimension, over their lengths where unit is set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            keys, vecs = zip(*held.pop(dim), strict=True)
            matrix = np.stack(vecs)
            if unit:
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                matrix = matrix / np.where(length == 0, 1, length)
            return pd.DataFrame({"keys": [np.array(keys, np.int64).tobytes()], "dim": [dim], "matrix": [matrix.tobytes()]})

        for frame in frames:
            for one, vec in zip(frame[name].tolist(), frame["vec"], strict=True):
                vec = None if vec is None else np.asarray(vec, np.float64)
                if vec is None or not len(vec) or not np.isfinite(vec).all():
                    continue
                held.setdefault(len(vec), []).append((one, vec))
                if len(held[len(vec)]) == rows:
                    yield block(len(vec))
        for dim in list(held):
            yield block(dim)

    return run


def retrieve(index: DataFrame, query: list[float], k: int | None = None, filter_type: str | None = None, default_k: int = 5) -> DataFrame:
    """Hits of one query; k of 0 or None is the default."""
    return top_k(index, query, k or default_k, filter_type=F.col("type") == filter_type if filter_type else None)


def fragment(rank: Column, text: Column, page: Column, section: Column, kind: Column | None = None) -> Column:
    """One hit's part of a context. With a kind it says what the fragment is; page 0 and an empty section stay hidden."""
    paged = F.coalesce(page, F.lit(0)) != 0
    where = F.concat(F.lit("стр. "), page.cast("string"), F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", раздел: "), section)).otherwise(""))
    if kind is not None:
        label = F.when(kind == "image_caption", "описание графика/изображения").otherwise("текст")
        info = F.concat(F.lit(" ("), label, F.when(paged, F.concat(F.lit(", "), where)).otherwise(""), F.lit(")"))
    else:
        info = F.when(paged, F.concat(F.lit(" ("), where, F.lit(")"))).otherwise("")
    return F.concat(F.lit("[Фрагмент "), rank.cast("string"), F.lit("]"), info, F.lit(":\n"), text)


def plain_fragment(rank: Column, text: Column, label: Column | None = None) -> Column:
    """`[Фрагмент i, label]:` or, without a label, `[i]:`, then the text on a line of its own."""
    head = F.concat(F.lit("[Фрагмент "), rank.cast("string"), F.lit(", "), label, F.lit("]")) if label is not None else F.concat(F.lit("["), rank.cast("string"), F.lit("]"))
    return F.concat(head, F.lit(":\n"), text)


def contexts(hits: DataFrame, queries: DataFrame, part: Column, query_key: str = "query_id") -> DataFrame:
    """(query_key, context): each query's fragments in order of rank; a query without hits says so."""
    joined = hits.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), BREAK)
    return queries.select(query_key).join(joined.select(query_key, text.alias("context")), query_key, "left").withColumn("context", F.coalesce("context", F.lit(NOTHING)))


def sources(hits: DataFrame) -> DataFrame:
    """What an answer says of its hits."""
    return hits.select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"), "page", "section", F.coalesce("type", F.lit("text")).alias("chunk_type"), F.substring("text", 1, 100).alias("text_preview"))


def top_sources(hits: DataFrame, most: int = 3) -> DataFrame:
    """The first `most` sources of each query."""
    return sources(hits).filter(F.col("rank") <= most)


def first_visual(chunks: DataFrame, words: list[str], *order: str) -> DataFrame:
    """The first chunk that holds any of the words, in any case."""
    found = F.lit(False)
    for w in words:
        found = found | F.lower("text").contains(w.lower())
    return chunks.filter(found).orderBy(*order).limit(1)
