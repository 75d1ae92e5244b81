import hashlib
import time
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.llm import queries, warc

SCHEMA = "page_id bigint, url string, html string, digest string, refers_to string, file string"


@pytest.fixture(scope="module")
def pages():
    long = "<p>" + "body " * 60 + "</p>"
    rows = [(i, f"http://h/{i}", long + str(i % 7)) for i in range(40)] + [(40, None, "short"), (41, "http://x/\r\ny", "short"), (42, "u", None), (43, "u", ""), (None, "u", long), (44, "u", long + "é日\U0001f600"), (45, "u", "x" * 3_000_000), (3, "again", long + "3")]
    return [(*r, "d", "r", "f") for r in rows]


def brute(pages):
    first = {}
    for p, _, h, *_ in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h, *_ in pages:
        raw = (h or "").encode()
        again = p is not None and len(raw) >= 100 and first[h or ""] < p
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, pages, compress):
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    manifest = warc.write(df, compress=compress, file_bytes=20_000)
    got = warc.read(spark, manifest)
    assert got.filter("record_type = 'gap'").count() == 0
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute(pages)
    assert manifest.agg({"records": "sum"}).first()[0] == len(pages)


def records(n, compress):
    out = []
    for i in range(n):
        data = warc.record("response", f"<urn:uuid:{i}>", b"payload %d " % i * 40, "x", {"X-Page-Id": str(i)})
        if compress:
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = c.compress(data) + c.flush()
        out.append(data)
    return out


def ids(found):
    return [x.kind if x.kind == "gap" else int(x.headers["x-page-id"]) for x in found]


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_one_record(compress):
    parts = records(12, compress)
    for k in (0, 5, 11):
        hurt = bytearray(b"".join(parts))
        at = sum(map(len, parts[:k])) + len(parts[k]) // 2
        hurt[at] ^= 0xFF
        found = warc.read_bytes(bytes(hurt))
        assert ids(found) == [*range(k), "gap", *range(k + 1, 12)]
        gap = next(x for x in found if x.kind == "gap")
        assert gap.start == sum(map(len, parts[:k])) and gap.end == sum(map(len, parts[: k + 1])) and gap.reason


@pytest.mark.parametrize("compress", [True, False])
def test_junk_truncation_and_lost_heads(compress):
    parts = records(5, compress)
    whole = b"".join(parts)
    assert ids(warc.read_bytes(b"junk" * 500_000 + whole)) == ["gap", 0, 1, 2, 3, 4]
    assert ids(warc.read_bytes(whole[:-9])) == [0, 1, 2, 3, "gap"]
    assert ids(warc.read_bytes(whole[7:])) == ["gap", 1, 2, 3, 4]
    assert ids(warc.read_bytes(parts[0] + b"\x1f\x8b\x08garbage" + b"WARC/1.0\r\nno" + parts[1])) == [0, "gap", 1]
    assert warc.read_bytes(b"") == [] and ids(warc.read_bytes(b"\n\n")) == ["gap"]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 5), st.booleans())
def test_any_junk_between_records_loses_none(junk, k, compress):
    parts = records(6, compress)
    found = ids(warc.read_bytes(b"".join(parts[:k]) + junk + b"".join(parts[k:])))
    assert [x for x in found if x != "gap"] == list(range(6))


@pytest.mark.parametrize("compress", [True, False])
def test_url_longer_than_64_kb(spark, compress):
    urls = {1: "http://h/" + "a" * 70_000, 2: "http://h/2", 3: "http://h/" + "b" * 2_500_000, 4: "http://h/4"}
    df = spark.createDataFrame([(k, u, f"<p>page {k}") for k, u in urls.items()], "page_id bigint, url string, html string").repartition(1)
    got = warc.read(spark, warc.write(df, compress=compress)).collect()
    assert {r.page_id: (r.record_type, r.url) for r in got} == {k: ("response", u) for k, u in urls.items()} and len(got) == 4


def test_header_without_end_costs_no_other_record():
    whole = warc.record("response", "<urn:uuid:1>", b"body", "d", {"X-Page-Id": "1"})
    lost = warc.VERSION + b"\r\nWARC-Target-URI: " + b"u" * 3_000_000 + b"\r\n"
    kinds = [r.kind for r in warc.read_bytes(whole + lost + whole + lost)]
    assert kinds == ["response", "gap", "response", "gap"]


def test_false_marks_cost_little():
    whole = warc.record("response", "<urn:uuid:1>", b"body", "d", {"X-Page-Id": "1"})
    n = 8_000_000
    for junk in (b"\x1f\x8b\x08garbage, and then some more of it until the next mark comes\n", b"WARC/1.1\r\nA: b\r\n\r\n and text, and text", b"WARC/1.1\r\nx: ", b"a: WARC/1.1\r\n", b"WARC/"):
        began = time.process_time()
        found = warc.read_bytes(whole + junk * (n // len(junk)) + b"\r\n" + whole)
        assert [r.kind for r in found] == ["response", "gap", "response"], junk
        assert time.process_time() - began < 4, junk


def test_damaged_length_reads_no_further():
    whole = warc.record("response", "<urn:uuid:1>", b"body", "d", {"X-Page-Id": "1"})
    hurt = whole.replace(b"Content-Length: 4", b"Content-Length: 2000000000")
    assert [r.kind for r in warc.read_bytes(hurt + whole)] == ["gap", "response"]


def test_sql(spark, tmp_path):
    """The query, on a small table, against its own SQL."""
    rows = [(k, f"http://h/{k}", h) for k, h in enumerate(["a" * 99, "a" * 99, "b" * 100, "b" * 100, None, "", "é" * 60, "é" * 60, "c" * 300_000, "<p>", "b" * 100])]
    rows[3] = (3, "u" * 1_000_000, rows[3][2])
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(path)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
        want = db.sql(queries.OP7_SQL).fetchall()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, queries.op7_warc(spark, str(tmp_path)).select(names).collect())) == sorted(want)


def test_lost_records_are_noticed(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "read", lambda spark, files, f=warc.read: f(spark, files).filter("page_id <> 7"))
    with pytest.raises(RuntimeError, match="records"):
        queries.read_whole(spark, warc.write(spark.createDataFrame(pages, SCHEMA)))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.read(spark, warc.write(none)).count() == 0


def test_every_revisit_names_its_record(spark, tmp_path):
    """WARC-Refers-To is the id of a record in the archives, of the same payload and url, whichever task wrote it."""
    body = "<p>" + "same text " * 20 + "</p>"
    rows = [(i, f"http://h/{i}", body if i % 3 else f"<p>{'own %d ' % i * 30}</p>") for i in range(1, 60)] + [(None, "http://none/", body), (70, None, body)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    found = [{}, {}]
    for k in range(2):
        files = [r.file.removeprefix("file://") for r in warc.write(pages, f"file://{tmp_path}/{k}").collect()]
        records = [x for f in files for x in warc.read_bytes(open(f, "rb").read())]
        assert sum(x.kind == "warcinfo" for x in records) == len(files) and not [x for x in records if x.kind == "gap"]
        held = {x.headers["warc-record-id"]: x for x in records if x.kind == "response"}
        again = [x for x in records if x.kind == "revisit"]
        assert len(again) == 40
        for x in again:
            first = held[x.headers["warc-refers-to"]]
            assert first.headers["warc-payload-digest"] == x.headers["warc-payload-digest"] and first.headers["x-page-id"] == x.headers["x-refers-to-page-id"] == "1"
            assert first.headers["warc-target-uri"] == x.headers["warc-refers-to-target-uri"]
        found[k] = {x.headers["x-page-id"]: i for i, x in held.items() if "x-page-id" in x.headers}
    assert found[0] == found[1]
