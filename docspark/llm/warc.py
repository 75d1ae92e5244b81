"""WARC archives: a writer that revisits repeated payloads, and a reader that salvages damaged files.

Writing: payload digests are compared by a narrow shuffle of (page_id, digest); the pages' bodies only meet the table
of revisits, and are not shuffled as long as Spark can broadcast it. Each task writes gzip members (or plain records) to files of bounded size under a name of its own and
reports them; only reported files count, so what a lost or repeated task leaves behind is never read.

Reading: a record is checked by its gzip trailer, its version line, its Content-Length, the blank lines after it and its
block digest. After a failed check the reader looks for the next valid start (a gzip member that inflates to a version
line, or a version line in plain files), goes on there, and logs the gap. The search never goes back, and a length is
checked against the bytes after the block before the block is read. Files are read in blocks, through the store of
their URI; memory is bounded by the longest record.

Defined cases: null html is an empty payload, and a null page_id or url is left out of the record; an empty table writes
nothing and reads as no rows; rows that repeat a page_id and its payload are one page stored twice, of the same type; of
equal payloads the smallest page_id is the response, and rows without a page_id are responses always;
urls and html of any length are stored and read whole; extra columns, whatever their names, are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import drop_stash, new_path, stash, with_workers

VERSION = b"WARC/1.1"
#: What a file says of itself, in a first record that readers pass over.
INFO = b"software: docspark\r\nformat: WARC File Format 1.1\r\n"
#: A payload smaller than this is always stored.
LEAST = 100
BLOCK = 1 << 20
INFLATE = 1 << 15
START = re.compile(rb"WARC/\d\.\d\r\n")
MAGIC = b"\x1f\x8b\x08"


# ------------------------------------------------------------ records


def record(kind: str, record_id: str, payload: bytes, digest: str, fields: dict[str, str]) -> bytes:
    """One record's bytes; a revisit stores no payload, but its digest and length."""
    block = payload if kind != "revisit" else b""
    sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()  # noqa: S324
    head = {
        "WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "text/html; charset=utf-8",
        "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload)), "WARC-Block-Digest": f"sha1:{sha1}", **fields, "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in head.items())
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Found:
    """A record read back, or (kind 'gap') a stretch of bytes that was passed over."""

    kind: str
    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str = ""


class Broken(ValueError):
    pass


def parse(data: bytes) -> Found:
    """One whole record, checked; end is where it ends in data."""
    start = START.match(data)
    stop = data.find(b"\r\n\r\n")
    if not start or stop < 0:
        raise Broken("no version line" if not start else "no end of header")
    headers: dict[str, str] = {}
    for line in data[start.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("malformed header line")
        headers[name.decode(errors="replace").lower()] = value.strip().decode(errors="replace")
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise Broken("no content length")
    end = stop + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Broken("cut short" if len(data) < end + 4 else "no blank lines after the block")
    block = data[stop + 4 : end]
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():  # noqa: S324
        raise Broken("block digest differs")
    return Found(headers.get("warc-type", ""), 0, end + 4, headers, block)


class Source:
    """Random access to a file's bytes, with one block of them at hand."""

    def __init__(self, file):
        self.file, self.size, self.first, self.held = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        """The n bytes from `at` on, fewer at the end."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if n > BLOCK:
            return self.file.read_at(n, at)
        self._hold(at, n)
        return self.held[at - self.first : at - self.first + n]

    def _hold(self, at: int, n: int) -> None:
        if not self.first <= at <= at + n <= self.first + len(self.held):
            self.first, self.held = at, self.file.read_at(min(2 * BLOCK, self.size - at), at)

    def find(self, mark: bytes, at: int) -> int:
        """Where mark is next found from `at` on, or the size."""
        while at < self.size:
            self._hold(at, min(len(mark), self.size - at))
            found = self.held.find(mark, at - self.first)
            if found >= 0:
                return self.first + found
            at = max(at + 1, self.first + len(self.held) - len(mark) + 1)
            if self.first + len(self.held) >= self.size:
                break
        return self.size


def _starts_well(source: Source, at: int) -> bool:
    """Whether the gzip member at `at` begins with a version line, as far as its first bytes tell; most false marks end here."""
    inflate, got = zlib.decompressobj(31), b""
    try:
        for n in (64, 1024):
            got += inflate.decompress(source.get(at, n) if n == 64 else source.get(at + 64, n), 10 - len(got))
            if len(got) >= 10:
                break
    except zlib.error:
        return False
    return len(got) < 10 or START.match(got) is not None


def _member(source: Source, at: int, most: int) -> tuple[bytes, int]:
    """The gzip member at `at`, inflated, and its length; `most` bounds what it may inflate to."""
    inflate, used, out, total = zlib.decompressobj(31), 0, [], 0
    while not inflate.eof:
        part = source.get(at + used, INFLATE)
        if not part:
            raise Broken("gzip member cut short")
        try:
            got = inflate.decompress(part)
        except zlib.error as e:
            raise Broken(f"gzip: {e}") from None
        used += len(part) - len(inflate.unused_data)
        if total < 10 <= total + len(got) and not START.match(b"".join([*out, got])):
            raise Broken("no version line")
        out.append(got)
        total += len(got)
        if total > most:
            raise Broken("member inflates beyond the bound")
    return b"".join(out), used


def _header(source: Source, at: int) -> tuple[int, str]:
    """Where the header at `at` ends, its blank line included, or where it goes wrong, and why."""
    line = at + 10
    while True:
        end = source.find(b"\r\n", line)
        if end == line:
            return end + 2, ""
        if end == source.size:
            return end, "no end of header"
        colon = source.find(b":", line) if end - line > BLOCK else line + source.get(line, end - line).find(b":")
        if not line <= colon < end:
            return line, "malformed header line"
        line = end + 2


def _plain(source: Source, at: int, most: int) -> tuple[bytes, int, int]:
    """The plain record at `at` and its length, and from where on another plain record may start if this one is none.

    Whatever start lies within a header that goes wrong, or ends in a block that does, goes wrong with it: lines are the same.
    """
    if not START.match(source.get(at, 10)):
        raise Broken("no version line")
    stop, reason = _header(source, at)
    if reason:
        raise Broken(reason, stop)
    size = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", source.get(at, stop - at), re.I)
    if not size or int(size[1]) > most:
        raise Broken("no content length" if not size else "length beyond the bound", stop)
    end = stop + int(size[1])
    if source.get(end, 4) != b"\r\n\r\n":  # looked at before the block is read
        raise Broken("cut short" if end + 4 > source.size else "no blank lines after the block", stop)
    return source.get(at, end + 4 - at), end + 4 - at, stop


def salvage(file, most: int = (1 << 31) + (1 << 27)) -> Iterator[Found]:
    """The records of a file in order, gzip members and plain records alike, with the gaps between them.

    file: a pyarrow file with random access. `most` lies beyond any text that Spark can hold. After a failed check the
    search goes on from there, each kind of mark on its own, and never back.
    """
    source, at, gap, reason = Source(file), 0, None, ""
    zipped = plain = -1  # the next marks of each kind, where known
    while at < source.size:
        after = at + 1
        try:
            if source.get(at, 3) == MAGIC:
                data, n = _member(source, at, most)
            else:
                data, n, after = _plain(source, at, most)
            found = parse(data)
            if found.end != len(data):
                raise Broken("bytes after the record")
        except Broken as e:
            if gap is None:
                gap, reason = at, str(e.args[0])
            after = max(after, e.args[1] if len(e.args) > 1 else 0)
            if zipped <= at:
                zipped = source.find(MAGIC, at + 1)
                while zipped < source.size and not _starts_well(source, zipped):
                    zipped = source.find(MAGIC, zipped + 1)
            if plain < after:
                plain = _next_plain(source, after)
            at = min(zipped, plain)
            continue
        if gap is not None:
            yield Found("gap", gap, at, reason=reason)
            gap = None
        found.start, found.end = at, at + n
        at += n
        yield found
    if gap is not None:
        yield Found("gap", gap, source.size, reason=reason)


def _next_plain(source: Source, at: int) -> int:
    at = source.find(b"WARC/", at)
    while at < source.size and not START.match(source.get(at, 10)):
        at = source.find(b"WARC/", at + 1)
    return at


# ------------------------------------------------------------ tables


def payload_digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, n, digest) of each page's payload."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", "url", F.octet_length(body).cast("bigint").alias("n"), F.sha2(body, 256).alias("digest"))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to, refers_url): pages whose payload a page of a smaller id has, of at least LEAST bytes.

    A group is reduced to its smallest id map-side first; the join back to its members is one that Spark may split.
    """
    rows = stash(payload_digests(pages).filter((F.col("n") >= LEAST) & F.col("page_id").isNotNull()), "payloads")
    first = rows.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last")).filter("first.page_id < last")
    first = first.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    return rows.drop("url").join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to", "refers_url").distinct()


def record_id(page: int | None, digest: str) -> str:
    """The id of a page's record, the same whichever task writes it; at random for a page without id."""
    own = uuid.uuid4() if page is None else uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}:{digest}")
    return f"<urn:uuid:{own}>"


def write(pages: DataFrame, path: str | None = None, compress: bool = True, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) under path, and returns the manifest (file, records, bytes)."""
    spark = with_workers(pages.sparkSession)
    root = path or new_path(spark, "warc")
    again = stash(revisits(pages), "revisits")
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    rows = own.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to", "refers_url")

    def run(batches):
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, name, count, size = None, "", 0, 0

        def pressed(data):
            if not compress:
                return data
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            return squeeze.compress(data) + squeeze.flush()

        def close():
            nonlocal out
            out.close()
            out = None
            return pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size]})

        for batch in batches:
            for page, url, html, digest, refers, refers_url in zip(*(batch.column(k) for k in range(6)), strict=True):
                body, page, url = html.as_py().encode(), page.as_py(), url.as_py()
                kind = "revisit" if refers.is_valid else "response"
                fields = {} if page is None else {"X-Page-Id": str(page)}
                fields |= {"WARC-Target-URI": url} if url is not None else {}
                if kind == "revisit":
                    fields |= {"WARC-Refers-To": record_id(refers.as_py(), digest.as_py()), "X-Refers-To-Page-Id": str(refers.as_py()), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    fields |= {"WARC-Refers-To-Target-URI": refers_url.as_py()} if refers_url.is_valid else {}
                data = pressed(record(kind, record_id(page, digest.as_py()), body, digest.as_py(), fields))
                if out is None:
                    name, count, size = f"part-{uuid.uuid4().hex}.warc" + ".gz" * compress, 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(pressed(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", INFO, hashlib.sha256(INFO).hexdigest(), {"Content-Type": "application/warc-fields", "WARC-Filename": name})))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    yield close()
        if out is not None:
            yield close()

    manifest = stash(rows.mapInArrow(run, "file string, records bigint, bytes bigint"), "manifest")
    drop_stash(again)
    return manifest.select(F.concat(F.lit(f"{root}/"), "file").alias("file"), "records", "bytes")


READ = "file string, start bigint, end bigint, record_type string, page_id bigint, url string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, gap string"


def read(spark: SparkSession, files: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the files (a column `file` of URIs), and one of type 'gap', with its reason, for each quarantined stretch."""

    def run(batches):
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in READ.split(", ")])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        rows, held = [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as file:
                    for x in salvage(file):
                        if x.kind == "warcinfo":
                            continue
                        rows.append((uri, x.start, x.end, *_row(x, payloads)))
                        held += len(x.block) * payloads
                        if len(rows) >= 2000 or held > 8 * BLOCK:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    with_workers(spark)
    n = max(1, spark.sparkContext.defaultParallelism * 4)
    return files.select("file").repartition(n).mapInArrow(run, READ)


def _row(x: Found, payloads: bool) -> tuple:
    if x.kind == "gap":
        return ("gap", None, None, None, None, None, None, x.reason)
    h = x.headers
    number = lambda s: int(s) if s is not None and re.fullmatch(r"-?\d+", s) else None
    if x.kind == "revisit":
        size, digest = number(h.get("x-payload-length")), h.get("warc-payload-digest", "").removeprefix("sha256:")
    else:
        size, digest = len(x.block), hashlib.sha256(x.block).hexdigest()
    refers = number(h.get("x-refers-to-page-id"))
    return (x.kind, number(h.get("x-page-id")), h.get("warc-target-uri"), size, digest, refers, x.block if payloads else None, None)


def read_bytes(data: bytes) -> list[Found]:
    return list(salvage(pa.BufferReader(data)))
