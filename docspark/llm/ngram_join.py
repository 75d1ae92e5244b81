"""N-gram Jaccard self-join with filters under several global token orders.

Sets are the distinct word shingles of whole texts as 64-bit hashes; equal sets form a class, and only classes are joined.

1. Document frequencies. Shingles go, packed and one entry per class and run of rows, to token ranges, where those of a
   single class are dropped; the others go, packed again, to their class with their frequency. A class can only link
   when at least 3/4 of its shingles are shared, so most end here, exactly. Tokens of very many classes are found
   beforehand, in a sample that grows with the corpus; they count as shared, and go to a salt of their class instead
   of one range, which no frequency can then fill. Ranges are bounded in number; beyond it they are cut within a task.
2. Prefixes. All orders put rare tokens first and differ in how ties and near ties are broken. A pair that links shares
   a token of both prefixes under every order; the first order finds candidates, the others must confirm them before a
   pair is verified, which counts the whole intersection.
3. Hot buckets. First every class is compared with the most central class of each of its buckets; the links found give
   components. Only pairs that lie in one bucket, but in different components, are left: they are searched block by
   block of bounded size, with an upper bound on the intersection from a small count sketch, so no pair that could link
   is passed over and no bucket is enumerated in full while its members are one component already.
4. Components come from min-label propagation with pointer jumping over stashed tables.

A leader with very many partners is one key of the joins that bring tokens and labels to pairs; its rows are narrow pairs
on one side and a single row on the other, which adaptive execution splits (spark.sql.adaptive.skewJoin, on by default).

The result is exact up to 64-bit hash collisions: no candidate, bucket or partner is capped.

Defined cases: null, empty or blank text has no shingles and links with nothing; with fewer words than k the whole
sequence is one shingle; rows that repeat a doc_id are documents of their own; a document without id links as any
other, and names no component: without any other member its component is null; texts of any length are shingled whole; an empty table gives an empty result.
Extra columns, whatever their names, pass through keep_one and don't appear in link_documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import BASE, drop_stash, in_files, mix, sent_whole, shingle_sets, slices, stash, tidy, told_apart, whole, with_workers

ORDERS = 3
BINS = 64
#: Hot tokens are looked for among the shingles of 1 / SAMPLE_SHARE of the rows, SAMPLE_ROWS of them at least and at most.
#: A token is hot when HOT_SEEN sampled classes have it, and they stand for HOT_ENTRIES entries; HOT_MOST tokens are at most.
SAMPLE_SHARE, SAMPLE_ROWS, HOT_SEEN, HOT_ENTRIES, HOT_MOST = 64, (4_000, 1_000_000), 10, 30_000, 1_000_000
BLOCK = 512
#: At most so many token ranges are keys of an exchange; a corpus that needs more has them cut within their tasks, from
#: so many bytes at a time.
MOST_RANGES, REPACK = 4096, 64 << 20
#: Of a place's entries a task works on about so many at a time, and sends on no more in a batch.
TURN = 1 << 18


def _bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])), len(sorted_keys))


def _class_of(tokens: np.ndarray) -> np.uint64:
    """An order-free 64-bit id of a set."""
    return mix(np.array([mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64))[0]


def _runs(batches, k: int, most: int = 1_000_000):
    """(row numbers, sets) of runs of rows with about `most` shingles, so that what is held does not follow the batch; with the batch."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        sets, first, held = [], 0, 0
        for at, data, offs in slices(column):
            sets += shingle_sets(data, offs, k)
            held += sum(map(len, sets[at - first :]))
            if held >= most:
                yield batch.slice(first, len(sets)), sets
                first, sets, held = first + len(sets), [], 0
        if sets:
            yield batch.slice(first, len(sets)), sets


def _distinct_classes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The ids of all sets, the distinct ids of those that aren't empty, and a set for each of these."""
    ids = np.array([_class_of(s) if len(s) else 0 for s in sets], np.uint64)
    full = np.flatnonzero([len(s) > 0 for s in sets])
    one, first = np.unique(ids[full], return_index=True)
    return ids, one, [sets[full[i]] for i in first]


# ------------------------------------------------------------ 1. sets and frequencies


def sample_rate(rows: int) -> int:
    """One of how many classes is looked at for hot tokens."""
    least, most = SAMPLE_ROWS
    return max(1, rows // min(most, max(least, rows // SAMPLE_SHARE)))


def shingled(docs: DataFrame, k: int, rate: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, cls) for documents, and (token in cls, count in n, sampled true) for the shingles of one in `rate` classes.

    The sample only decides which way a token goes, never whether it counts.
    """

    def run(batches):
        for rows, sets in _runs(batches, k):
            ids, one, members = _distinct_classes(sets)
            drawn = [s for c, s in zip((mix(one ^ BASE) % np.uint64(rate)).tolist(), members, strict=True) if c == 0]
            tokens, times = np.unique(np.concatenate(drawn), return_counts=True) if drawn else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([rows.column(0), pa.nulls(len(tokens), pa.int64())]),
                    pa.array(np.concatenate([n, times])),
                    pa.concat_arrays([pa.array(ids.view(np.int64), mask=n == 0), pa.array(tokens.view(np.int64))]),
                    pa.array(np.concatenate([np.zeros(len(n), bool), np.ones(len(tokens), bool)])),
                ],
                names=["doc_id", "n", "cls", "sampled"],
            )

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), "doc_id bigint, n bigint, cls bigint, sampled boolean")


#: Packed entries on their way to a place: tokens and frequencies, and for each the index of its class among `classes`.
PACKED = "place int, tokens binary, dfs binary, owners binary, classes binary, sizes binary"


def _pack(place: np.ndarray, tokens: np.ndarray, dfs: np.ndarray | None, owner: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """A row for each place."""
    order = np.argsort(place, kind="stable")
    tokens, owner, place = tokens[order], owner[order], place[order]
    dfs = dfs[order].astype(np.uint32) if dfs is not None else None
    at = _bounds(place)
    cols: list[list] = [[] for _ in PACKED.split(",")]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        used, local = np.unique(owner[a:b], return_inverse=True)
        kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
        values = (int(place[a]), tokens[a:b].tobytes(), dfs[a:b].tobytes() if dfs is not None else b"", local.astype(kind).tobytes(), classes[used].tobytes(), sizes[used].astype(np.uint32).tobytes())
        for col, value in zip(cols, values, strict=True):
            col.append(value)
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])


def _turns(batches: Iterable[pa.RecordBatch], by_class: bool, most: int = TURN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, frequencies (or none), classes and sizes of PACKED entries, about `most` at a time: a class, or else a token,
    has all its entries in one turn. What waits stays packed, as it came."""
    packs = []
    for batch in batches:
        for cells in zip(*(batch.column(i) for i in range(1, 6)), strict=True):
            t, d, o, c, n = (x.as_buffer() for x in cells)
            owners = np.uint16 if o.size == t.size // 4 else np.uint32
            packs.append(tuple(np.frombuffer(x, kind) if x.size else np.zeros(0, kind) for x, kind in ((t, np.uint64), (d, np.uint32), (o, owners), (c, np.uint64), (n, np.uint32))))
    turns = min(1 << 16, -(-sum(len(p[0]) for p in packs) // most))
    turn_of = lambda x: (mix(x ^ BASE) % np.uint64(turns)).astype(np.uint16)
    due = [turn_of(c)[o] if by_class else turn_of(t) for t, _, o, c, _ in packs] if turns > 1 else []
    for k in range(turns):
        parts: list[list] = [[], [], [], []]
        for i, (t, d, o, c, n) in enumerate(packs):
            if turns > 1:
                at = np.flatnonzero(due[i] == k)
                t, d, o = t[at], d[at] if len(d) else d, o[at]
            for part, value in zip(parts, (t, d, c[o], n[o]), strict=True):
                part.append(value)
        yield tuple(np.concatenate(p) for p in parts)


def counted(batches: Iterable[pa.RecordBatch], ranges: int, hot: np.ndarray, hot_df: np.ndarray, salted: bool) -> Iterator[pa.RecordBatch]:
    """PACKED entries of a place's shared tokens with their frequencies, for places of classes; salted: the tokens are hot ones."""
    kept: list[tuple] = []

    def packed() -> pa.RecordBatch:
        t, df, c, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        kept.clear()
        classes, first, owner = np.unique(c, return_index=True, return_inverse=True)
        return _pack((mix(c) % np.uint64(ranges)).astype(np.int32), t, df, owner, classes, n[first])

    for t, _, c, n in _turns(batches, False):
        order = np.lexsort((c, t))
        t, c, n = t[order], c[order], n[order]
        fresh = np.append(True, (t[1:] != t[:-1]) | (c[1:] != c[:-1]))[: len(t)]  # a class may come from several batches
        t, c, n = t[fresh], c[fresh], n[fresh]
        if salted:
            df = hot_df[np.searchsorted(hot, t)]
        else:
            at = _bounds(t)
            df = np.repeat(np.diff(at), np.diff(at))
        keep = df > 1
        kept.append((t[keep], df[keep].astype(np.uint32), c[keep], n[keep]))
        if sum(len(x[0]) for x in kept) >= TURN:
            yield packed()
    if sum(len(x[0]) for x in kept):
        yield packed()


def met(batches: Iterable[pa.RecordBatch], share: Fraction) -> Iterator[pa.RecordBatch]:
    """PREPARED rows of a place's classes that share enough tokens to link."""
    for t, df, c, n in _turns(batches, True):
        order = np.argsort(c, kind="stable")
        t, df, c, n = t[order], df[order], c[order], n[order]
        at = _bounds(c)
        sizes = n[at[:-1]].astype(np.int64)
        able = [(int(c[a].view(np.int64)), int(m), t[a:b], df[a:b].astype(np.int64)) for a, b, m in zip(at[:-1].tolist(), at[1:].tolist(), sizes.tolist(), strict=True) if b - a >= needed(m, share)]
        if able:
            yield from prepared(able, share).to_batches()


def by_place(packed: DataFrame, partitions: int, parts: int, part_of, work, schema: str) -> DataFrame:
    """work(batches) for the PACKED rows of each place, or for each of the `parts` that a place is cut into.

    A place is one exchange's key. Where a place is more than a task should hold at once, its partition is packed anew by
    parts, sorted by them (which spills), and read part by part; so partitions need not grow with the corpus. part_of
    gives an entry's part from its place, token and class.
    """
    dealt = packed.repartition(partitions, "place")
    if parts == 1:
        return dealt.groupBy("place").applyInArrow(tidy(lambda batches: work(list(batches))), schema)

    def cut(batches):
        def flush():
            ((t, d, c, n),) = _turns(held, False, size)
            counts = [x.as_buffer().size // 8 for batch in held for x in batch.column(1)]
            place = np.repeat(np.concatenate([batch.column(0).to_numpy() for batch in held]), counts).astype(np.int64)
            classes, first, owner = np.unique(c, return_index=True, return_inverse=True)
            return _pack((place * parts + part_of(place, t, c)).astype(np.int32), t, d if len(d) else None, owner, classes, n[first])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= REPACK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def in_turn(batches):
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            place = batch.column(0).to_numpy()
            ends = _bounds(place).tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if rest and rest[-1].column(0)[0].as_py() != int(place[a]):
                    yield from work(rest)
                    rest = []
                rest.append(batch.slice(a, b - a))
        if rest:
            yield from work(rest)

    return dealt.mapInArrow(tidy(cut), PACKED).sortWithinPartitions("place").mapInArrow(tidy(in_turn), schema)


def able_classes(docs: DataFrame, k: int, share: Fraction, ranges: int, parts: int, hot: np.ndarray, hot_df: np.ndarray, text: str = "text") -> DataFrame:
    """The classes that can link at all, as PREPARED rows with their class as id.

    Two packed exchanges: by token range, where a token's classes are counted, and by class, where what is shared meets.
    """
    held = docs.sparkSession.sparkContext.broadcast((hot, hot_df))
    span = np.uint64((1 << 64) // ranges + 1)

    def part_of_range(place, tokens, classes):
        by_token = tokens % span // np.uint64(int(span) // parts + 1)
        return np.where(place >= ranges, mix(classes ^ BASE) % np.uint64(parts), by_token).astype(np.int64)

    def part_of_class(place, tokens, classes):
        return (mix(classes) // np.uint64(ranges) % np.uint64(parts)).astype(np.int64)

    def scatter(batches):
        hot, _ = held.value
        for _, sets in _runs(batches, k, 2 * TURN):
            _, one, members = _distinct_classes(sets)
            if not members:
                continue
            sizes = np.array([len(s) for s in members], np.int64)
            tokens = np.concatenate(members)
            owner = np.repeat(np.arange(len(one), dtype=np.int32), sizes)
            place = (tokens // span).astype(np.int32)
            if len(hot):
                known = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
                place[known] = ranges + (one[owner[known]] % np.uint64(ranges)).astype(np.int32)
            yield _pack(place, tokens, None, owner, one, sizes)

    def count(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return counted(batches, ranges, *held.value, batches[0].column(0)[0].as_py() // parts >= ranges)

    def meet(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return met(batches, share)

    by_range = by_place(docs.select(text).mapInArrow(tidy(scatter), PACKED), 2 * ranges, parts, part_of_range, count, PACKED)
    return by_place(by_range, ranges, parts, part_of_class, meet, PREPARED)


# ------------------------------------------------------------ 2. prefixes


def needed(n: int, share: Fraction) -> int:
    """The least intersection a set of n tokens has with one that it links with."""
    return -(-n * share.numerator // share.denominator)


def order_keys(tokens: np.ndarray, df: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort keys, last one first, of a global order: rare tokens first; the orders break ties and near ties differently."""
    if which == 0:
        return tokens, df
    return mix(tokens ^ np.uint64(0xA0761D6478BD642F * which % (1 << 64))), np.frexp(df.astype(np.float64))[1]


PREPARED = "id bigint, n bigint, centre double, sketch binary, tokens binary, first binary, other1 binary, other2 binary"


def prepared(classes: list[tuple[int, int, np.ndarray, np.ndarray]], share: Fraction) -> pa.Table:
    """PREPARED of (id, n, shared tokens, their frequencies): sorted tokens, a count sketch, and a prefix for each order."""
    rows: list[list] = [[] for _ in PREPARED.split(",")]
    for own, n, t, df in classes:
        q = len(t) - needed(n, share) + 1
        firsts = [np.sort(t[np.lexsort(order_keys(t, df, w))[:q]]).tobytes() for w in range(ORDERS)]
        sketch = np.bincount((mix(t) % np.uint64(BINS)).astype(np.int64), minlength=BINS).astype(np.uint16).tobytes() if len(t) < 65535 else b""
        for col, v in zip(rows, (own, n, float(df.sum() + n - len(t)) / n, sketch, np.sort(t).tobytes(), *firsts), strict=True):
            col.append(v)
    kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * 5]
    return pa.table({x.split()[0]: pa.array(c, t) for x, c, t in zip(PREPARED.split(", "), rows, kinds, strict=True)})


def explode_prefix(batches):
    """(id, n, centre, first) to a row for each token of the prefix under the first order."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer() or b"") // 8 for x in batch.column(3)], np.int64)
        rep = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        tokens = np.frombuffer(b"".join(x.as_py() for x in batch.column(3)), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tokens), *(batch.column(i).take(rep) for i in range(3))], names=["token", "id", "n", "centre"])


# ------------------------------------------------------------ verification


def verifier(share: Fraction):
    """mapInArrow over pairs with both sides' prefixes and tokens: the pairs that link."""
    up, down = share.numerator, share.denominator

    def meets(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        at = np.searchsorted(y, x)
        return bool((y[np.minimum(at, len(y) - 1)] == x).any())

    def run(batches):
        for batch in batches:
            left, right = [], []
            cols = [batch.column(i) for i in range(10)]
            for i in range(len(batch)):
                a, b, na, nb = (cols[j][i].as_py() for j in range(4))
                if not (meets(cols[4][i].as_py(), cols[5][i].as_py()) and meets(cols[6][i].as_py(), cols[7][i].as_py())):
                    continue
                x, y = np.frombuffer(cols[8][i].as_py(), np.uint64), np.frombuffer(cols[9][i].as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if down * both >= up * (na + nb - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def links(pairs: DataFrame, ready: DataFrame, share: Fraction) -> DataFrame:
    """Of distinct pairs (a, b) those that link."""
    names = ["n", "other1", "other2", "tokens"]
    side = lambda s: ready.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in names))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", *(f"{c}_{s}" for c in names for s in "ab")).mapInArrow(tidy(verifier(share)), "a bigint, b bigint")


# ------------------------------------------------------------ 3. hot buckets


def cross_pairs(share: Fraction):
    """mapInArrow over rows sorted by group: pairs of different labels, one of them not of the bucket's main label, that
    the lengths and the sketches allow."""
    up, down = share.numerator, share.denominator

    def pairs(ids, lab, n, minor, side, sketches):
        """side: 0 in the searched block, 1 among those it is searched in."""
        a, b = np.flatnonzero(minor & (side == 0)), np.flatnonzero(side == 1)
        out = []
        for s in range(0, len(b), 256):
            c = b[s : s + 256]
            ok = lab[a][:, None] != lab[c][None]
            ok &= down * np.minimum(n[a][:, None], n[c][None]) >= up * np.maximum(n[a][:, None], n[c][None])
            i, j = np.nonzero(ok)
            for z in range(0, len(i), 20_000):
                p, q = a[i[z : z + 20_000]], c[j[z : z + 20_000]]
                most = np.minimum(sketches[p], sketches[q]).sum(1, dtype=np.int64)
                fit = (down + up) * most >= up * (n[p] + n[q])
                out.append(np.stack([ids[p[fit]], ids[q[fit]]], 1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def run(batches):
        rest = None
        for batch in (*batches, None):
            table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]) if rest is not None or batch is not None else None
            if table is None or not len(table):
                rest = batch if batch is not None and len(batch) else None
                continue
            own = table.combine_chunks().to_batches()[0]
            keys = np.stack([own.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            at = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))), len(own))
            whole = len(at) - 1 if batch is None else len(at) - 2
            rest = None if batch is None else own.slice(int(at[whole]))
            ids, lab, n, minor, side = (own.column(i).to_numpy(zero_copy_only=False) for i in range(3, 8))
            raw = own.column(8).to_pylist()
            sketches = np.stack([np.frombuffer(x, np.uint16) if x else np.full(BINS, 65535, np.uint16) for x in raw])
            found = [np.zeros((0, 2), np.int64)]
            for k in range(whole):
                s = slice(int(at[k]), int(at[k + 1]))
                found.append(pairs(ids[s], lab[s], n[s], minor[s], side[s], sketches[s]))
            got = np.concatenate(found)
            low, high = got.min(1), got.max(1)
            keep = np.unique(np.stack([low, high], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keep[:, 0]), pa.array(keep[:, 1])], names=["a", "b"])

    return run


def remaining(entries: DataFrame, labels: DataFrame, sketches: DataFrame, share: Fraction, block: int = BLOCK) -> DataFrame:
    """Distinct candidate pairs of one bucket that no component holds together yet. Only members of such buckets get their sketch."""
    labelled = stash(entries.select("token", "id", "n").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
    per = labelled.groupBy("token", "label").agg(F.count("*").alias("m"))
    buckets = per.groupBy("token").agg(F.sum("m").alias("g"), F.max(F.struct("m", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    buckets = buckets.select("token", F.col("main.label").alias("main"), F.ceil((F.col("g") - F.col("main.m")) / block).cast("int").alias("minor_blocks"), F.ceil(F.col("g") / block).cast("int").alias("chunks"))
    rows = labelled.join(buckets, "token").withColumn("minor", F.col("label") != F.col("main"))
    own_block, own_chunk = F.pmod(F.xxhash64("id", F.lit(1)), "minor_blocks").cast("int"), F.pmod(F.xxhash64("id", F.lit(2)), "chunks").cast("int")
    # A minor member meets its block of searchers in every chunk; every member is searched once for each block.
    searchers = rows.filter("minor").withColumn("i", own_block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(0))
    searched = rows.withColumn("j", own_chunk).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1))).withColumn("side", F.lit(1))
    cols = ["token", "i", "j", "id", "label", "n", "minor", "side"]
    roles = searchers.select(cols).unionByName(searched.select(cols)).join(sketches, "id").select(*cols, "sketch")
    grouped = roles.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return grouped.mapInArrow(tidy(cross_pairs(share)), "a bigint, b bigint").distinct()


# ------------------------------------------------------------ 4. components


def components(edges: DataFrame) -> DataFrame:
    """(id, label): for each node of undirected edges (a, b), a stashed table, the smallest node reachable."""
    n = 2 * edges.count()
    both = stash(in_files(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), n), "edges")
    labels = stash(in_files(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), n), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("label", "near").alias("new"), "label")
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("further"))
        after = step.join(jump, "new", "left").select("id", F.least("new", "further").alias("label"), (F.least("new", "further") < F.col("label")).alias("moved"))
        after = stash(in_files(after, n), "labels")
        drop_stash(labels)
        if not after.filter("moved").limit(1).count():
            drop_stash(both)
            return after.drop("moved")
        labels = after.drop("moved")


# ------------------------------------------------------------ the operator


def link_documents(docs: DataFrame, k: int = 5, share: Fraction = Fraction(3, 4), doc_id: str = "doc_id", text: str = "text", range_tokens: int = 2_000_000, most_ranges: int = MOST_RANGES) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of docs."""
    spark = with_workers(docs.sparkSession)
    n_docs = docs.count()
    rate = sample_rate(n_docs)
    found = stash(shingled(docs, k, rate, doc_id, text), "sets")
    rows = found.filter("not sampled").select("doc_id", "n", "cls")
    classes = stash(in_files(rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("id"), F.min("n").alias("n")), n_docs), "classes")
    tokens = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = found.filter("sampled").groupBy("cls").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(HOT_SEEN, HOT_ENTRIES // rate))
    seen = often.orderBy(F.desc("n"), "cls").limit(HOT_MOST).toArrow()  # 16 bytes each
    hot, times = seen.column("cls").to_numpy().view(np.uint64), seen.column("n").to_numpy()
    order = np.argsort(hot)
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // range_tokens), 1)
    ranges = min(wanted, max(1, most_ranges))
    able = able_classes(docs, k, share, ranges, -(-wanted // ranges), hot[order], np.minimum(times[order] * rate, (1 << 32) - 1), text)
    ready = stash(able, "prepared")  # a class is told by its hash until components get their names: it may have no id
    entries = stash(ready.select("id", "n", "centre", "first").mapInArrow(tidy(explode_prefix), "token bigint, id bigint, n bigint, centre double"), "entries")
    leaders = entries.groupBy("token").agg(F.max(F.struct("centre", "id", "n")).alias("top"), F.count("*").alias("g")).filter("g > 1").select("token", F.col("top.id").alias("lead"), F.col("top.n").alias("lead_n"))
    fits = share.denominator * F.least("n", "lead_n") >= share.numerator * F.greatest("n", "lead_n")
    pairs = entries.join(leaders, "token").filter((F.col("id") != F.col("lead")) & fits).select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    near = stash(links(pairs, ready, share), "links")
    first = components(near)
    rest = stash(remaining(entries, first, ready.select("id", "sketch"), share), "candidates")
    label = lambda side: first.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
    far = links(rest, ready, share).join(label("a"), "a", "left").join(label("b"), "b", "left")
    between = far.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).distinct()  # one link of two components is enough
    between = stash(between, "between")
    second = components(between)
    drop_stash(near, rest, ready, entries, between)
    second = second.select(F.col("id").alias("label"), F.col("label").alias("further"))
    parts = first.unionByName(second.select(F.col("label").alias("id"), "label")).groupBy("id").agg(F.min("label").alias("label"))
    joined = parts.join(second, "label", "left").select("id", F.coalesce("further", "label").alias("label"))
    members = joined.join(classes.select("cls", F.col("id").alias("own")), F.col("id") == F.col("cls")).select("cls", "label", "own")
    smallest = members.groupBy("label").agg(F.min("own").alias("component"))
    named = classes.join(members.join(smallest, "label").select("cls", "component"), "cls", "left").select("cls", F.coalesce("component", "id").alias("component"))
    out = rows.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_broadcast: int = 2_000_000, **settings) -> DataFrame:
    """The rows of docs whose id is their component's, with all their columns; of rows that repeat it, one.

    Texts stay where they are: ids that go are looked up, from a broadcast table where there are at most most_broadcast
    of them and by a shuffle beyond that.
    """
    linked = link_documents(docs, doc_id=doc_id, text=text, **settings)
    by_id = linked.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id") == F.col("component_id")).alias("heads"))
    touched = stash(in_files(by_id.filter("rows > 1 or heads = 0").select("doc_id", (F.col("heads") == 0).alias("gone")), docs.count()), "touched")
    mine = docs.select(whole(docs), F.col(f"`{doc_id}`").cast("bigint").alias("id"))
    known = sent_whole(touched, most_broadcast)
    out = mine.join(known, mine["id"] == known["doc_id"], "left_anti").select("whole.*")
    repeated = touched.filter("not gone")
    if not repeated.limit(1).count():
        return out
    once = mine.join(repeated, mine["id"] == repeated["doc_id"], "left_semi").groupBy("id").agg(F.max_by("whole", told_apart(docs)).alias("whole"))
    return out.unionByName(once.select("whole.*"))


__all__ = ["components", "keep_one", "link_documents"]
