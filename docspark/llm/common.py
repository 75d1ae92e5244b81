"""What the operators share: tables in the shared folder, and numpy kernels over Arrow text buffers."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

from docspark.plans import workers
from docspark.plans.shared import drop_stash, new_path, settings, stash  # noqa: F401  the operators take them from here

#: The separators between words: space and U+0009 to U+000D, as a Java regex class and as characters.
SPACES = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Text is handled in slices of about this many bytes, so memory does not follow the Arrow batch.
SLICE_BYTES = 1 << 20


#: What Python workers are started with: large arrays go back to the system as soon as they are freed, Arrow's as well.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304"}


def with_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers started by a driver that found this package on sys.path find it as well, and keeps batches of
    texts small: a worker and its JVM hold several copies of a batch."""
    if spark.conf.get(BATCH_ROWS) == "10000":  # the default
        spark.conf.set(BATCH_ROWS, "2000")
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    return workers.with_workers(spark)


def give_back() -> None:
    """Returns what this worker has freed to the system; idle workers are kept."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow and the like, whose worker returns in the end what the task has freed, and doesn't sit on it
    while Spark works without Python."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Narrow rows, ids and numbers, are written in files of so many at least, where there are as many.
FILE_ROWS = 50_000


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """df of narrow rows, about `rows` in all, by as many tasks as files of FILE_ROWS need; never more tasks than it has."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def sent_whole(df: DataFrame, most: int, size: str = "count(*)"):
    """df to be broadcast where its size, an aggregate, is at most `most`; else as it is, and joins shuffle."""
    return F.broadcast(df) if (df.selectExpr(size).first()[0] or 0) <= most else df


def doc_bucket(doc_id, n: int):
    """crc32 of the decimal doc_id, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


# ---------------------------------------------------------------- kernels


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column laid end to end, and the len + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, size: int = SLICE_BYTES):
    """(first row, bytes, offsets) of runs of rows of about size bytes; a longer text has a run of its own."""
    data, offs = flat(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def text_blocks(column: pa.Array, size: int = SLICE_BYTES):
    """Lists of texts of about size bytes together."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for k, s in enumerate(sizes.tolist()):
        total += s
        if total >= size:
            yield column.slice(at, k + 1 - at).to_pylist()
            at, total = k + 1, 0
    if at < len(sizes):
        yield column.slice(at).to_pylist()


def text_column(spark: SparkSession, kind: DataType, make: Callable[[], Callable[[pa.Array], pa.Array]]):
    """A function from a text column to a column of `kind`: texts alone travel to the workers, and results alone return.

    make() is called once a task; what it returns, and what that holds, is gone with the task.
    """
    with_workers(spark)

    @F.arrow_udf(kind)
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = make()
        for batch in batches:
            yield own(batch)
        del own
        give_back()

    return column


def whole(df: DataFrame):
    """All columns of df as one struct named whole, beside which no name of ours can meet one of theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("whole")


def told_apart(df: DataFrame):
    """A number from all of a row's columns (within `whole`) that can be hashed."""
    return F.xxhash64(F.lit(0), *(f"whole.`{c}`" for c, t in df.dtypes if "map<" not in t and "variant" not in t))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_texts(df: DataFrame, fields: str, make, text: str = "text") -> DataFrame:
    """df's columns but text, and `fields`, a schema, in place of any so named. make() is called once a task, and what it
    returns turns a list of texts into a list of tuples."""
    extra = StructType.fromDDL(fields)
    arrow = pa.struct(list(to_arrow_schema(extra)))

    def columns():
        own = make()

        def run(column: pa.Array) -> pa.Array:
            rows = [row for block in text_blocks(column) for row in own(block)]
            return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], arrow.field(k).type) for k in range(len(extra))], fields=list(arrow))

        return run

    found = free_name(df, "found")
    others = [c for c in df.columns if c != text and c not in extra.names]
    made = df.select(*(F.col(f"`{c}`") for c in others), text_column(df.sparkSession, extra, columns)(F.col(f"`{text}`").cast("string")).alias(found))
    return made.select(*(F.col(f"`{c}`") for c in others), *(F.col(f"`{found}`.{c}").alias(c) for c in extra.names))


BASE = np.uint64(0x9E3779B97F4A7C17)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of the rows."""
    inside = ~IS_SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edges = offs[(offs < len(data))]
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    before[edges] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after[offs[offs <= len(data)]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


#: Spans beyond so many bytes are hashed one by one.
LONG_SPAN = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time, each mixed in by a bijection, so that no arithmetic relation of
    two spans makes them equal; long ones by BLAKE2."""
    n = (ends - starts).astype(np.int64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(n.astype(np.uint64) + BASE)
    at, begin = np.flatnonzero((n > 0) & (n <= LONG_SPAN)), 0
    while len(at):
        lane = eights[starts[at] + begin] & _MASKS[np.minimum(n[at] - begin, 8)]
        h[at] = mix(h[at] ^ lane) + BASE
        begin += 8
        at = at[n[at] > begin]
    for i in np.flatnonzero(n > LONG_SPAN):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its k-word shingles, A-Z lower-cased; the whole sequence as one where there are fewer words."""
    low = LOWER[data]
    starts, ends, row = word_spans(low, offs)
    words = span_hashes(low, starts, ends)
    n_rows, m = len(offs) - 1, np.uint64(0xD6E8FEB86659FD93)
    first = np.searchsorted(row, np.arange(n_rows + 1))
    acc = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        acc = (acc ^ words[j : len(words) - k + 1 + j]) * m
        acc ^= acc >> np.uint64(29)
    acc = mix(acc)
    out = []
    for i in range(n_rows):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            s = np.sort(acc[a : b - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
        elif b > a:
            h = np.array([b - a], np.uint64) * BASE
            for j in range(a, b):
                h = (h ^ words[j]) * m
                h ^= h >> np.uint64(29)
            out.append(mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
