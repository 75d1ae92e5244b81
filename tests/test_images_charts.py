from pyspark.sql import functions as F

from docspark.operators import charts, images

IMAGES = "doc_id string, page_num int, idx int, image_hash string, width int, height int"


def test_sizes_dedup_numbers_and_bound(spark):
    rows = [("d", 2, 0, "b", 60, 100), ("d", 0, 1, "a", 60, 100), ("d", 1, 0, "a", 60, 100), ("d", 3, 0, "c", 49, 200), ("d", 3, 1, "e", 50, 99), ("d", 3, 2, "f", 50, 100), ("e", 0, 0, "a", 50, 101)]
    df = spark.createDataFrame(rows, IMAGES)
    got = lambda most: sorted((r.doc_id, r.image_no, r.page_num, r.image_hash) for r in images.extract(df, most).collect())
    every = [("d", 1, 0, "a"), ("d", 2, 2, "b"), ("d", 3, 3, "f"), ("e", 1, 0, "a")]
    assert got(None) == got(0) == every
    assert got(1) == [every[0], every[3]]
    s = images.summary(images.extract(df)).first()
    assert (s.total_images, s.pages_with_images, s.pages, s.avg_width, s.total_pixels) == (4, 3, "1,3,4", 55, 6000 + 6000 + 5000 + 5050)
    assert images.summary(df.filter("false")).first().total_images == 0
    assert {r.doc_id: r.sizes for r in images.sizes(df).collect()}["e"] == ["50x101"]


def test_boxes(spark):
    pics = spark.createDataFrame([(1, 1, 7), (1, 1, 8)], "doc_id int, page_num int, xref int")
    infos = spark.createDataFrame([(1, 1, 7, 2, "late"), (1, 1, 7, 1, "first")], "doc_id int, page_num int, xref int, info_no int, bbox string")
    pages = spark.createDataFrame([(1, 1, "page")], "doc_id int, page_num int, rect string")
    assert sorted((r.xref, r.bbox) for r in images.with_boxes(pics, infos, pages).collect()) == [(7, "first"), (8, "page")]


def test_two_classes(spark):
    df = spark.createDataFrame([(0, [5.0, 5.0, 5.0, 1.0, 1.0, 1.0]), (1, [1.0] * 6), (2, None), (3, [0.0, 0.0, 0.0, 9.0, 0.0, 0.0])], "i int, logits array<double>")
    got = {r.i: r for r in charts.chart_or_image(df).collect()}
    assert [got[i].block_type for i in range(4)] == ["chart", "image", "image", "image"]
    assert got[1].confidence == 0.5 and got[2].confidence == 0.0 and got[0].chart_score > 0.3
    chart, other = images.split_kinds(charts.chart_or_image(df))
    assert chart.count() == 1 and other.count() == 3
    assert tuple(images.count_kinds(charts.chart_or_image(df)).first()) == (1, 3)


def test_subtypes(spark):
    df = spark.createDataFrame([(0, [0.0, 3.0, 3.0, *[0.0] * 6]), (1, None)], "i int, logits array<double>")
    got = {r.i: r for r in charts.subtype(df).collect()}
    assert got[0].chart_subtype == "line chart or line graph" and got[1].chart_subtype == "unknown" and got[1].confidence == 0
    label = df.select(charts.subtype_label(F.lit("histogram")).alias("a"), charts.subtype_label(F.lit("unknown")).alias("b")).first()
    assert tuple(label) == ("Гистограмма", "unknown")


def test_ocr(spark):
    df = spark.createDataFrame([("  ab \n\nabc\n7\n12\n x y z ",), (None,)], "t string")
    assert [r.x for r in df.select(charts.clean_ocr(F.col("t")).alias("x")).collect()] == ["abc\n7\n12\nx y z", ""]
    boxes = spark.createDataFrame([([("a ", 31), ("b", 30), (" ", 99)],), (None,)], "b array<struct<text:string,conf:int>>")
    assert [r.x for r in boxes.select(F.transform(charts.ocr_boxes(F.col("b")), lambda x: x["text"]).alias("x")).collect()] == [["a"], None]
    flags = df.select(charts.has_text(F.lit("x" * 11)).alias("a"), charts.has_text(F.lit("x" * 10)).alias("b"), charts.has_lines(F.lit(3)).alias("c"), charts.has_lines(F.lit(None).cast("int")).alias("d")).first()
    assert tuple(flags) == (True, False, True, False)


def test_descriptions(spark):
    make = lambda caption, ocr: spark.range(1).select(charts.fallback_description(F.lit("График"), F.lit(caption), F.lit(ocr))).first()[0]
    assert make("", "") == "График." and make("cap", " ") == "График. (BLIP: cap)."
    assert make("", "aaa bbb AAA ccc ddd eee fff ggg hhh iii") == "График. Ключевые слова: aaa, bbb, ccc, ddd, eee, fff, ggg, hhh."


def color(r, g, b):
    rules = [(r > 200 and g < 80 and b < 80, "красный"), (r < 80 and g > 200 and b < 80, "зелёный"), (r < 80 and g < 80 and b > 200, "синий"), (r > 200 and g > 200 and b < 80, "жёлтый"), (r > 200 and g > 100 and b < 80, "оранжевый"), (r > 150 and g < 80 and b > 150, "фиолетовый"), (r < 80 and g > 150 and b > 150, "бирюзовый"), (80 < r < 180 and 80 < g < 180 and 80 < b < 180, "серый"), (r > 200 and g > 150 and b > 150, "розовый"), (r < 100 and g < 100 and b < 100, "тёмный")]
    return next((name for holds, name in rules if holds), "цветной")


def test_colors(spark):
    steps = [0, 79, 80, 81, 99, 101, 150, 151, 179, 180, 200, 201, 255]
    rows = [(r, g, b) for r in steps for g in steps for b in steps]
    got = spark.createDataFrame(rows, "r int, g int, b int").select("r", "g", "b", charts.color_name(F.col("r"), F.col("g"), F.col("b")).alias("x")).collect()
    assert all(x.x == color(x.r, x.g, x.b) for x in got)
    clusters = spark.createDataFrame([(1, 0, 210, 10, 10, 60), (1, 1, 240, 240, 240, 20), (1, 2, 10, 10, 10, 10), (1, 3, 10, 220, 10, 6), (1, 4, 100, 100, 100, 4)], "k int, cluster int, r int, g int, b int, n bigint")
    got = charts.dominant_colors(clusters, "k", most=1).first()
    assert got.dominant_colors == ["красный (#d20a0a, 60%)"] and got.num_color_segments == 2
