import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import chunking, learned_vectors, retrieval
from docspark.plans import shared
from docspark.sources import backends

SF = "/root/testdata/sf0.01"
TEXTS = ["red cat and red dog", "Cat, dog; cat!", "", None, "one", "red cat and red dog", "the sun is over the hill the sun"]


def bucket(word, words):
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % words  # noqa: S324


def counted(texts, words, reach):
    out = Counter()
    for t in texts:
        b = [bucket(w, words) for w in re.findall(r"\w+", (t or "").lower())]
        for i, x in enumerate(b):
            for y in b[i + 1 : i + 1 + reach]:
                out[x, y] += 1
                out[y, x] += 1
    return out


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, word string")


@pytest.mark.parametrize("held", [1 << 22, 16])
def test_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(learned_vectors, "HELD", held)  # texts in parts
    long = TEXTS + [" ".join(f"w{i * i % 13}" for i in range(200))]
    got = {(r.word, r.context): r.n for r in learned_vectors.near_words(rows_of(spark, long).repartition(3), 64, 3).collect()}
    assert got == counted(long, 64, 3)


def test_model_is_the_matrix_s_leading_part(spark):
    docs, words = rows_of(spark, TEXTS * 3), 32
    pairs = counted(TEXTS * 3, words, 4)
    own = Counter()
    for (a, _), n in pairs.items():
        own[a] += n
    powers, matrix = sum(n**0.75 for n in own.values()), np.zeros((words, words))
    for (a, b), n in pairs.items():
        matrix[a, b] = max(0.0, math.log(n * powers / (own[a] * own[b] ** 0.75)))
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    # With a block as wide as the matrix the result is exact: all directions above 0, weighed by their values.
    model = learned_vectors.fit(docs, dim=words, words=words, spectrum=0.5)
    up = values > 1e-9
    assert np.allclose(model.vectors @ model.vectors.T, (vectors[:, up] * values[up]) @ vectors[:, up].T, atol=1e-4)
    again = learned_vectors.fit(docs.repartition(5), dim=words, words=words, spectrum=0.5)
    assert np.array_equal(model.vectors, again.vectors)


def test_vectors(spark):
    docs = rows_of(spark, TEXTS)
    got = [np.array(r.vec) for r in learned_vectors.embed(docs, learned_vectors.fit(docs, dim=8, words=64)).orderBy("doc_id").collect()]
    assert [round(float(np.linalg.norm(v)), 6) for v in got] == [1, 1, 0, 0, 0, 1, 1] and np.array_equal(got[0], got[5])
    assert got[0] @ got[1] > got[0] @ got[6]
    nothing = learned_vectors.embed(docs, learned_vectors.fit(docs.filter("false"), dim=8, words=64)).collect()
    assert all(not any(r.vec) for r in nothing)


def test_passages_are_found_more_often(spark):
    """Passages of `benchmark` among the chunks of `documents`, against hashed vectors of the same size."""
    docs, items = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "benchmark"))
    truth = {(r.item_id, r.doc_id) for r in items.select("item_id", F.col("text").alias("t")).join(docs, F.expr("contains(lower(text), lower(t))")).select("item_id", "doc_id").collect()}
    chunks = shared.stash(chunking.chunk_simple(docs).select("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id()), "chunks")
    asked = items.select(F.col("item_id").alias("query_id"), "text")

    def found(vectors):
        best = retrieval.top_k_batch(vectors(chunks), vectors(asked), 3).join(chunks, "row_id")
        return len({(r.query_id, r.doc_id) for r in best.select("query_id", "doc_id").collect()} & truth)

    model = learned_vectors.fit(docs, dim=64, words=1 << 13)
    hashed = found(lambda df: df.withColumn("vec", backends.embed_text(F.col("text"), dim=64)))
    assert found(lambda df: learned_vectors.embed(df, model)) > hashed > 0


def test_packed_rows_stay_short(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(f"w{i * k % 97}" for i in range(200)),) for k in range(1, 6)], "text string")
    want = sorted(map(tuple, learned_vectors.near_words(docs, 64).collect()))
    monkeypatch.setattr(learned_vectors, "PIECE", 1)
    rows = learned_vectors.pair_blocks(docs, 64).collect()
    assert max(len(r.steps) // r.wide for r in rows) == 1 and len(rows) > len({r.place for r in rows})
    assert sorted(map(tuple, learned_vectors.near_words(docs, 64).collect())) == want
