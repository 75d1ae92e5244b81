import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.llm import ngram_join, queries
from docspark.llm.common import mix, shingle_sets, span_hashes

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def test_matches_brute_force(docs, rows):
    got = ngram_join.link_documents(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


def thue_morse(n, a, b):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_words_whose_polynomial_sums_agree_are_apart(spark):
    """Such words have equal sums over every odd base modulo 2^64."""
    rows = []
    for i, n in enumerate((8, 64, 256, 512, 1024, 2048, 4096)):
        rows += [(10 * i + j, f"one two {thue_morse(n, *x)} four five") for j, x in enumerate(("ab", "ba"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, ngram_join.link_documents(df).collect())) == sorted((i, 1, i) for i, _ in rows)
    words = [thue_morse(n, *x).encode() for n in (256, 512, 2048) for x in ("ab", "ba")]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    assert len(set(span_hashes(data, ends - [len(w) for w in words], ends).tolist())) == len(words)


def test_a_document_without_id_joins_others(spark):
    x = [f"w{i}" for i in range(100)]
    a, b = [*x[:90], *(f"a{i}" for i in range(10))], [*(f"b{i}" for i in range(10)), *x[10:]]
    for middle in (3, None):
        rows = [(1, " ".join(a)), (middle, " ".join(x)), (2, " ".join(b)), (None, "without id and alone here today"), (None, None)]
        got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)
        assert {r.component_id for r in got.filter("doc_id < 3").collect()} == {1}


def test_chains_and_buckets_beyond_a_block(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(160):  # drifting copies: neighbours link, ends do not
        if i % 2:
            base = base[3:] + [f"n{i}.{j}" for j in range(3)]
        rows.append((i, " ".join(base)))
    for i in range(160, 400):  # one passage in many texts that do not link
        rows.append((i, " ".join([f"p{j}" for j in range(40)] + [f"u{i}.{rng.random()}" for _ in range(rng.choice([4, 12, 30, 60]))])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, ngram_join.link_documents(df, range_tokens=500).collect())) == sorted(brute(rows))
    assert sorted(map(tuple, ngram_join.link_documents(df, range_tokens=500, most_ranges=3).collect())) == sorted(brute(rows))  # ranges cut within tasks


def test_blocks_of_one_bucket_find_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join.remaining, "__defaults__", (3,))
    rng = random.Random(8)
    rows = []
    for g in range(6):
        core = [f"c{j}" for j in range(30)] + [f"g{g}.{j}" for j in range(6)]
        for _ in range(7):
            words = list(core)
            words[rng.randrange(len(words))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, ngram_join.link_documents(df).collect())) == sorted(brute(rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té ", max_size=40), min_size=1, max_size=6))
def test_shingle_sets_have_the_right_sizes(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.cumsum([0, *map(len, raw)])
    sets = shingle_sets(data, offs, 2)
    assert [len(s) for s in sets] == [len(shingles(t, 2)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert (set(sets[i].tolist()) == set(sets[j].tolist())) == (shingles(texts[i], 2) == shingles(texts[j], 2))


def test_a_pair_that_links_shares_a_prefix_token_under_every_order():
    rng, share = np.random.default_rng(2), Fraction(3, 4)
    for _ in range(300):
        x = rng.choice(400, rng.integers(1, 60), replace=False).astype(np.uint64)
        y = np.unique(np.append(rng.permutation(x)[: max(1, int(len(x) * 0.9))], rng.choice(400, 3).astype(np.uint64)))
        df = dict(zip(range(400), rng.integers(2, 50, 400).tolist(), strict=True))
        both = len(np.intersect1d(x, y))
        if 4 * both < 3 * (len(x) + len(y) - both):
            continue
        sides = [ngram_join.prepared([(0, len(s), np.sort(s), np.array([df[t] for t in np.sort(s).tolist()], np.int64))], share) for s in (x, y)]
        for name in ("first", "other1", "other2"):
            a, b = (set(np.frombuffer(s.column(name)[0].as_py(), np.uint64).tolist()) for s in sides)
            assert a & b


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (3, 40), (40, 50), (50, 60), (60, 70)]
    got = dict(map(tuple, ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 40: 1, 50: 1, 60: 1, 70: 1, 10: 10, 11: 10, 12: 10}


def test_stage_keeps_one_of_each_component(docs, rows):
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    want = {c for _, _, c in brute(rows) if c is not None}
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want)


def test_empty(empty):
    assert ngram_join.link_documents(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0


def test_hot_tokens_take_another_way_to_the_same_result(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_SEEN", 3)
    monkeypatch.setattr(ngram_join, "HOT_ENTRIES", 3)
    assert sorted(map(tuple, ngram_join.link_documents(docs).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_sample_grows_with_the_corpus():
    seen = [n // ngram_join.sample_rate(n) for n in (10, 10**4, 10**6, 10**8, 10**11)]
    assert seen == sorted(seen) and seen[0] == 10 and seen[-1] >= 10**6


def test_stage_keeps_columns_that_clash(spark):
    low = -(1 << 63)
    rows = [(low, "a b c d e f", {"k": 1}, "p"), (1, "A b c d e f", {}, "q"), (7, "x y z", None, "r"), (7, "other words", {"z": 2}, "s"), (8, "", {}, "t"), (None, "n", {}, "u")]
    own = spark.createDataFrame(rows, "doc_id bigint, text string, __id map<string,int>, __nth string").withColumn("whole", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("gone", F.lit(3))
    for settings_ in ({}, {"most_broadcast": 0}):
        got = ngram_join.keep_one(own, **settings_)
        assert got.columns == own.columns
        assert sorted(repr(r.doc_id) for r in got.collect()) == sorted(map(repr, [low, 7, 8, None]))


def test_sql(spark, tmp_path):
    """The query, on a small table, against its own SQL."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(k, t) for k, t in enumerate([base, base.upper(), base.replace("w30", "new"), base.replace("w30", "new").replace("w50", "more"), "a b c", "A  b\tc", "", None, " ", base + " end", "x y z w v u"])]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        want = db.sql(queries.OP1_SQL).fetchall()
    assert sorted(map(tuple, queries.op1_ngram_join(spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id").collect())) == sorted(want)


def test_a_place_is_worked_on_in_turns():
    """A task holds a place's entries packed, and a small part of them as arrays; batches that it sends on are small."""
    rng, classes = np.random.default_rng(3), 3000
    own = np.sort(rng.integers(1, 1 << 63, classes, np.int64).astype(np.uint64))
    owner, tokens = np.repeat(np.arange(classes), 500), mix(rng.integers(0, 400_000, classes * 500).astype(np.uint64))
    sizes = np.full(classes, 500, np.int64)
    packs = [ngram_join._pack(np.zeros(250_000, np.int32), tokens[a : a + 250_000], None, owner[a : a + 250_000], own, sizes) for a in range(0, len(tokens), 250_000)]
    pairs = np.unique(np.stack([tokens, own[owner]], 1), axis=0)
    _, back, times = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
    want = {(t, c): n for (t, c), n in zip(map(tuple, pairs.tolist()), times[back].tolist(), strict=True) if n > 1}
    none = np.zeros(0, np.uint64)
    tracemalloc.start()
    made = [(batch, tracemalloc.reset_peak()) for batch in ngram_join.counted([*packs, packs[0]], 7, none, none, False)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = [x for t, df, c, _ in ngram_join._turns([b for b, _ in made], True) for x in zip(t.tolist(), c.tolist(), df.tolist(), strict=True)]
    assert len(got) == len(want) and {(t, c): n for t, c, n in got} == want
    assert most < 64 << 20 and max(b.nbytes for b, _ in made) < 10 << 20 and len(made) > 2
    whole = [x for b, _ in made for x in ngram_join.met([b], Fraction(1, 100))]
    assert all(b.nbytes < 16 << 20 for b in whole)
    shared = [x for x in ngram_join.met([b for b, _ in made], Fraction(3, 4))]
    counts = Counter(c for _, c in want)
    assert sorted(np.concatenate([b.column(0).to_numpy() for b in shared]).view(np.uint64).tolist()) == sorted(c for c, n in counts.items() if n >= 375)
