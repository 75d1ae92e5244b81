"""Back ends, with stand-ins for the libraries on the workers (tests/stand_ins) and an endpoint of our own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docspark.operators import charts, generation, index, retrieval
from docspark.plans import pipeline
from docspark.plans.workers import with_workers
from docspark.sources import backends, sinks

CHART = {"size": [120, 90], "chart": True, "text": "Доход растёт 2020 2021 and more words", "pixels": [[210, 10, 10, 60], [10, 10, 210, 36], [250, 250, 250, 4]]}
PHOTO = {"size": [80, 80], "chart": False, "text": "sea", "pixels": [[90, 90, 90, 10]], "alpha": 1, "colours": 4}
SMALL = {"size": [20, 20], "chart": False, "text": "x", "pixels": [[0, 0, 0, 1]]}


def block(text):
    return {"type": 0, "bbox": [0, 0, 1, 1], "lines": [{"spans": [{"text": text}]}]}


PDF = {
    "pages": [
        {"rect": [0, 0, 600, 800], "blocks": [block("ОТЧЁТ О ДОХОДАХ"), block("The report tells of sales in all regions over many years, and of what changed. " * 2)], "images": [7, 9, 7, 99], "info": [{"xref": 7, "bbox": [1, 2, 3, 4]}]},
        {"rect": [0, 0, 600, 800], "blocks": [{"type": 1, "bbox": [0, 0, 1, 1]}, block("A second page with some text that goes on and on for a while, so that it is a chunk.")], "images": [8, 7], "info": []},
    ],
    "xrefs": {"7": CHART, "8": PHOTO, "9": SMALL},
}


@pytest.fixture(scope="module")
def own(spark):
    with_workers(spark)
    env, folder = spark.sparkContext.environment, str(Path(__file__).parent / "stand_ins")
    before = env["PYTHONPATH"]
    env["PYTHONPATH"] = f"{folder}:{before}"
    yield spark
    env["PYTHONPATH"] = before


@pytest.fixture
def endpoint():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((dict(self.headers), body))
            prompt = body["messages"][-1]["content"]
            said = json.dumps({"choices": [{"message": {"content": "Столбцы дохода по годам." if "Тип графика (CLIP)" in prompt else "An answer."}}], "usage": {"total_tokens": 3}}).encode()
            self.send_response(500 if "fail" in prompt else 200)
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield generation.Endpoint(url=f"http://127.0.0.1:{server.server_port}/chat", key="test", timeout=5), asked
    server.shutdown()


@pytest.fixture(scope="module")
def pdf(own, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdf")
    (folder / "report.pdf").write_text(json.dumps(PDF))
    (folder / "note.txt").write_text("no PDF")
    return folder


def test_pdf_mapping(own, pdf):
    files = backends.read_files(own, f"file://{pdf}")
    assert files.count() == 1
    rows = backends.pdf_blocks(files).orderBy("page_num", "block_no").collect()
    assert [(r.page_num, r.block_no, r.type) for r in rows] == [(1, 0, 0), (1, 1, 0), (2, 0, 1), (2, 1, 0)]
    assert rows[0].lines[0].spans[0].text == "ОТЧЁТ О ДОХОДАХ" and rows[2].lines == [] and tuple(rows[0].bbox) == (0, 0, 1, 1)
    found = backends.pdf_images(files).orderBy("page_num", "idx").collect()
    assert [(r.page_num, r.idx, r.xref, r.width, r.height) for r in found] == [(1, 0, 7, 120, 90), (1, 2, 7, 120, 90), (2, 0, 8, 80, 80), (2, 1, 7, 120, 90)]  # 9 is small, 99 fails
    assert tuple(found[0].bbox) == (1, 2, 3, 4) and tuple(found[2].bbox) == (0, 0, 600, 800) and found[0].image_hash == found[1].image_hash != found[2].image_hash


def pictures(own):
    return own.createDataFrame([(1, bytearray(json.dumps(CHART).encode())), (2, bytearray(json.dumps(PHOTO).encode())), (3, bytearray(b"no image")), (4, None)], "i int, png binary")


def test_recognition(own):
    png = F.col("png")
    got = pictures(own).select("i", backends.ocr_text(png).alias("ocr"), backends.caption(png).alias("said"), backends.line_count(png).alias("lines"), backends.ocr_boxes(png).alias("boxes"), backends.pixel_clusters(png).alias("clusters"))
    got = got.withColumns({"boxes": charts.ocr_boxes(F.col("boxes")), "colours": charts.dominant_of(F.col("clusters"))})
    one, two, bad, none = got.orderBy("i").collect()
    assert one.ocr == CHART["text"] and one.said == "This image shows Доход" and one.lines == 4 and [b.text for b in one.boxes] == ["and", "more", "words"]
    assert one.colours.dominant_colors == ["красный (#d20a0a, 60%)", "синий (#0a0ad2, 36%)"] and one.colours.num_color_segments == 2
    assert two.colours.dominant_colors == ["серый (#5a5a5a, 100%)"] and two.lines == 1
    for r in (bad, none):
        assert (r.ocr, r.said, r.lines, r.boxes, r.colours.dominant_colors, r.colours.num_color_segments) == ("", "", 0, [], [], 0)


def test_models_and_what_is_missing(own):
    png, good = F.col("png"), pictures(own).filter("i < 3")
    got = charts.chart_or_image(good.withColumn("logits", backends.image_logits(png, charts.CHART_PROMPTS + charts.IMAGE_PROMPTS)))
    assert [r.block_type for r in got.orderBy("i").collect()] == ["chart", "image"]
    row = good.select(backends.embed_images(png).alias("a"), backends.embed_image_text(F.lit("x")).alias("b"), backends.embed_images(png, "missing").alias("c"), backends.image_logits(png, ["x"], "missing").alias("d"), backends.caption(png, "missing").alias("e")).first()
    assert row.a == [0.6, 0.8] and row.b == [0.0, 1.0] and row.c is None and row.d is None and row.e == ""
    texts = own.createDataFrame([("abc",), (None,)], "t string").select(backends.embed_text(F.col("t"), "some").alias("a"), backends.embed_text(F.col("t"), "missing", 4).alias("b")).collect()
    assert texts[0].a == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and texts[1].a == [0.0, 1.0] and len(texts[0].b) == 4 and texts[1].b == [0.0] * 4


def test_image_files(own, tmp_path):
    (tmp_path / "a.png").write_text(json.dumps(CHART))
    rows = own.createDataFrame([(1, f"{tmp_path}/a.png"), (2, f"file://{tmp_path}/a.png"), (3, f"{tmp_path}/none.png"), (4, None)], "i int, path string")
    assert [r.t for r in rows.select("i", backends.ocr_files(F.col("path")).alias("t")).orderBy("i").collect()] == [CHART["text"], CHART["text"], "", ""]


def test_chart_blocks(own, endpoint):
    found = own.createDataFrame([("d", 1, 0, bytearray(json.dumps(CHART).encode()), "c.png"), ("d", 1, 1, bytearray(json.dumps(PHOTO).encode()), "p.png")], "doc_id string, page_num int, idx int, png binary, image_path string")
    plain = {r.block_type: r for r in pipeline.image_blocks(found).collect()}
    c = plain["chart"].chart
    assert c.dominant_colors == ["красный (#d20a0a, 60%)", "синий (#0a0ad2, 36%)"] and c.num_color_segments == 2 and c.num_lines == 4 and c.has_lines and c.has_text
    assert c.gpt_description.startswith(c.chart_subtype_ru) and "Ключевые слова: Доход" in c.gpt_description and plain["image"].image.ocr_text == "sea"
    told, asked = endpoint
    described = {r.block_type: r for r in pipeline.image_blocks(found, told).collect()}
    assert described["chart"].chart.gpt_description == "Столбцы дохода по годам." and "Столбцы дохода" in described["chart"].text
    assert CHART["text"] in asked[0][1]["messages"][-1]["content"] and asked[0][0]["Authorization"] == "test"
    down = generation.Endpoint(url="http://127.0.0.1:9/none", key="test", timeout=0.2)
    assert {r.block_type: r for r in pipeline.image_blocks(found, down).collect()}["chart"].chart.gpt_description == c.gpt_description


def test_ingest_pdfs_end_to_end(own, pdf, endpoint, tmp_path):
    told, asked = endpoint
    p = pipeline.Pipeline(own, f"file://{tmp_path}/index", dim=32, endpoint=told)
    counts = p.ingest_pdfs(f"file://{pdf}", image_dir=f"file://{tmp_path}/images").first()
    assert counts.blocks["chart"] == 1 and counts.blocks["image"] == 1 and counts.llm_available
    assert sorted(x.name for x in (tmp_path / "images").iterdir()) == ["report_p1_img1.png", "report_p2_img2.png"]
    texts = [r.text for r in index.load(own, p.path).collect()]
    assert any("Столбцы дохода" in t and f"file://{tmp_path}/images/report_p1_img1.png" in t for t in texts)
    questions = own.createDataFrame([(1, "what of sales?"), (2, "please fail")], "query_id bigint, question string")
    answers, sources = p.query(questions)
    got = {r.query_id: r for r in answers.collect()}
    assert got[1].answer == "An answer." and got[1].model == told.model and got[1].usage.total_tokens == 3 and got[2].model == "stub"
    assert {r.rank for r in retrieval.top_sources(sources.withColumnsRenamed({"chunk_type": "type", "text_preview": "text"}), 2).collect()} == {1, 2}
    assert p.ingest_pdfs(f"file://{pdf}", process_images=False).first().index_size > 0


def test_projection(own):
    rows = own.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)], "row_id bigint, vec array<double>")
    xy = {r.row_id: r.xy for r in backends.project(rows).collect()}
    steps = [abs(xy[i + 1][0] - xy[i][0]) for i in range(9)]
    assert len(xy) == 10 and steps == pytest.approx([5**0.5] * 9) and max(abs(v[1]) for v in xy.values()) == pytest.approx(abs(xy[0][1]))


def test_markdown_files(own, tmp_path):
    docs = own.createDataFrame([("a/b.pdf", "# x\n\ny"), ("c", None)], "doc_id string, markdown string")
    assert sinks.export_markdown(docs, f"file://{tmp_path}/md").count() == 2
    assert (tmp_path / "md" / "b.pdf.md").read_text() == "# x\n\ny" and (tmp_path / "md" / "c.md").read_text() == ""


def test_ingest_parses_and_classifies_once(own, pdf, tmp_path):
    """Each page is read once for text and once for images, and each image that is kept is classified once."""
    env, log = own.sparkContext.environment, tmp_path / "calls"
    env["STAND_IN_LOG"] = str(log)
    try:
        pipeline.Pipeline(own, f"file://{tmp_path}/index").ingest_pdfs(f"file://{pdf}", image_dir=f"file://{tmp_path}/images").collect()
    finally:
        del env["STAND_IN_LOG"]
    calls = log.read_text().split()
    assert {c: calls.count(c) for c in set(calls)} == {"text": 2, "images": 2, "kinds": 2, "subtypes": 1}
