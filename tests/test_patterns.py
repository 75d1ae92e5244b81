import random

import numpy as np
from pyspark.sql import functions as F

from docspark.operators import patterns


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_automaton_finds_what_in_finds(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(patterns, "STRETCH", 7)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abж") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 25))})
        texts = ["".join(rng.choice("abжx ") for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(rng.randint(0, 12))]
        text, word = patterns.Automaton([w.encode() for w in words]).find(*flat(texts))
        assert sorted(zip(text.tolist(), word.tolist(), strict=True)) == [(i, j) for i, t in enumerate(texts) for j, w in enumerate(words) if w in t]


def test_steps_do_not_follow_the_number_of_words(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(50)]
    for n in (10, 5000):
        words = sorted({"".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(n)})
        looked, automaton = [], patterns.Automaton([w.encode() for w in words])
        plain = np.searchsorted
        monkeypatch.setattr(patterns.np, "searchsorted", lambda *a: looked.append(1) or plain(*a))
        automaton.find(*flat(texts))
        monkeypatch.undo()
        assert len(looked) == 400


def test_first_holding(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice("abcЖ ") for _ in range(rng.randint(0, 80)))) for i in range(300)] + [(None, "abc abc"), (300, None), (301, "")]
    words = [(g, "".join(rng.choice("abcж") for _ in range(rng.randint(2, 7)))) for g in range(60) for _ in range(3)] + [(60, ""), (61, None), (62, "nowhere"), (0, "aa"), (0, "aa"), (63, "ЖЖ")]
    want = {}
    for g, w in words:
        hits = [i for i, t in docs if w and t and i is not None and w.lower() in t.lower()]
        if hits:
            want[g] = min(*hits, want[g]) if g in want else min(hits)
    df, asked = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(words, "item bigint, word string")
    assert dict(map(tuple, patterns.first_holding(df, asked, "doc_id").collect())) == want
    assert patterns.first_holding(df, asked.filter("item = 61"), "doc_id").collect() == [] and patterns.first_holding(df.filter("false"), asked, "doc_id").collect() == []
    assert patterns.first_holding(df, asked, "doc_id").schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert patterns.first_holding(df, asked.withColumn("item", F.col("item").cast("string")), "doc_id").count() == len(want)
