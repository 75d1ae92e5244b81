"""Chart and image analysis after the models: probabilities, colours, recognised text, descriptions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import is_digits, keywords, let, strip, text_of
from docspark.functions.vectors import arg_max, mean, softmax

# Chart kinds in the order of their probabilities, and their labels.
SUBTYPES = {
    "bar chart or column chart": "Столбчатая/полосовая диаграмма",
    "line chart or line graph": "Линейный график",
    "pie chart or donut chart": "Круговая диаграмма",
    "scatter plot or dot plot": "Точечная диаграмма",
    "histogram": "Гистограмма",
    "area chart": "Диаграмма с областями",
    "flowchart or block diagram": "Блок-схема",
    "table with data": "Таблица с данными",
    "organizational chart or tree diagram": "Организационная диаграмма",
}

# What an image is compared with to tell charts from other images.
CHART_PROMPTS = ["a bar chart, line chart, pie chart, or histogram with data", "a graph or diagram showing statistics or trends", "a chart with axes, labels, and numerical data"]
IMAGE_PROMPTS = ["a photograph, logo, icon, or illustration", "a screenshot, picture, or decorative image", "a photo of a person, building, object, or scene"]


def with_softmax(df: DataFrame, logits: str = "logits", name: str = "probs") -> DataFrame:
    return df.withColumn("__top", F.array_max(logits)).withColumn(name, softmax(F.col(logits), F.col("__top"))).drop("__top")


def chart_or_image(df: DataFrame, logits: str = "logits", groups: int = 3) -> DataFrame:
    """Adds block_type, confidence, chart_score, image_score from logits of `groups` chart and as many image prompts.

    Means of each group's probabilities decide; a tie, or no logits, is an image.
    """
    probs = with_softmax(df, logits, "__probs")
    chart, image = mean(F.slice("__probs", 1, groups)), mean(F.slice("__probs", groups + 1, groups))
    both = probs.withColumn("__chart", F.coalesce(chart, F.lit(0.0))).withColumn("__image", F.coalesce(image, F.lit(0.0)))
    total = F.col("__chart") + F.col("__image")
    out = both.withColumn("block_type", F.when(F.col("__chart") > F.col("__image"), "chart").otherwise("image"))
    out = out.withColumn("confidence", F.when(total > 0, F.greatest("__chart", "__image") / total).otherwise(0.0))
    return out.withColumn("chart_score", F.round("__chart", 4)).withColumn("image_score", F.round("__image", 4)).drop("__probs", "__chart", "__image")


def subtype(df: DataFrame, logits: str = "logits", names: list[str] | None = None) -> DataFrame:
    """Adds chart_subtype and confidence, the first of the largest probabilities; without logits unknown and 0."""
    names = names or list(SUBTYPES)
    probs = with_softmax(df, logits, "__probs").withColumn("__at", arg_max(F.col("__probs")))
    named = F.get(F.array(*[F.lit(n) for n in names]), F.col("__at"))
    return probs.withColumn("chart_subtype", F.coalesce(named, F.lit("unknown"))).withColumn("confidence", F.coalesce(F.array_max("__probs"), F.lit(0.0))).drop("__probs", "__at")


def subtype_label(kind: Column, labels: dict[str, str] = SUBTYPES) -> Column:
    """The label of a kind, or the kind itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*labels.items())]), kind), kind)


def clean_ocr(text: Column) -> Column:
    """Stripped lines that are longer than two characters or all digits."""
    lines = F.transform(F.split(text_of(text), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: (F.length(x) > 2) | is_digits(x)), "\n")


def ocr_boxes(boxes: Column, least: int = 30) -> Column:
    """Boxes with text and a confidence above `least`; none for null."""
    kept = F.filter(boxes, lambda b: (strip(text_of(b["text"])) != "") & (b["conf"].cast("int") > least))
    return F.transform(kept, lambda b: b.withField("text", strip(b["text"])))


def has_text(ocr: Column) -> Column:
    return F.length(strip(text_of(ocr))) > 10


def has_lines(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)) > 2


def fallback_description(label: Column, caption: Column, ocr: Column) -> Column:
    """Kind, caption and up to eight keywords, as far as there are any."""
    listed = lambda words: F.when(F.size(words) > 0, F.concat(F.lit("Ключевые слова: "), F.array_join(F.slice(words, 1, 8), ", ")))
    return F.concat(
        F.concat_ws(
            ". ",
            label,
            F.when(text_of(caption) != "", F.concat(F.lit("(BLIP: "), caption, F.lit(")"))),
            let(keywords(ocr), listed),
        ),
        F.lit("."),
    )


def color_name(r: Column, g: Column, b: Column) -> Column:
    """The first rule that holds names the colour. Bounds and names."""
    low = lambda *c: [x < 80 for x in c]
    rules = [
        ([r > 200, *low(g, b)], "красный"),
        ([g > 200, *low(r, b)], "зелёный"),
        ([b > 200, *low(r, g)], "синий"),
        ([r > 200, g > 200, *low(b)], "жёлтый"),
        ([r > 200, g > 100, *low(b)], "оранжевый"),
        ([r > 150, b > 150, *low(g)], "фиолетовый"),
        ([g > 150, b > 150, *low(r)], "бирюзовый"),
        ([(x > 80) & (x < 180) for x in (r, g, b)], "серый"),
        ([r > 200, g > 150, b > 150], "розовый"),
        ([x < 100 for x in (r, g, b)], "тёмный"),
    ]
    out = None
    for conditions, name in rules:
        every = conditions[0]
        for c in conditions[1:]:
            every = every & c
        out = F.when(every, name) if out is None else out.when(every, name)
    return out.otherwise("цветной")


def color_shares(pixels: DataFrame, *key: str) -> DataFrame:
    """(key, cluster, r, g, b, n, share) of pixels' clusters, largest first within key by n."""
    counts = pixels.groupBy(*key, "cluster").agg(*(F.avg(c).cast("int").alias(c) for c in "rgb"), F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))


def dominant_of(clusters: Column, least: float = 0.05, most: int = 5) -> Column:
    """struct<dominant_colors, num_color_segments> of an array of (cluster, r, g, b, n).

    Shares below `least`, near white and near black go; segments are counted before the cut to `most`.
    """
    edge = lambda c, low: (c["r"] < 25) & (c["g"] < 25) & (c["b"] < 25) if low else (c["r"] > 230) & (c["g"] > 230) & (c["b"] > 230)
    code = lambda c: F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c[k]), 2, "0") for k in "rgb"]))

    def listed(total: Column) -> Column:
        kept = F.filter(clusters, lambda c: (c["n"] / total >= least) & ~edge(c, False) & ~edge(c, True))
        said = lambda c: F.concat(color_name(c["r"], c["g"], c["b"]), F.lit(" ("), code(c), F.lit(", "), F.bround(c["n"] / total * 100, 0).cast("int").cast("string"), F.lit("%)"))
        return F.array_sort(F.transform(kept, lambda c: F.struct((-c["n"]).alias("neg"), c["cluster"].alias("cluster"), said(c).alias("text"))))

    total = F.aggregate(clusters, F.lit(0).cast("bigint"), lambda s, c: s + c["n"])
    every = let(total, listed)
    return let(every, lambda x: F.struct(F.slice(F.transform(x, lambda y: y["text"]), 1, most).alias("dominant_colors"), F.size(x).alias("num_color_segments")))


def dominant_colors(clusters: DataFrame, *key: str, least: float = 0.05, most: int = 5) -> DataFrame:
    """(key, dominant_colors, num_color_segments) of (key, cluster, r, g, b, n), for keys with any colour left."""
    listed = clusters.groupBy(*key).agg(F.collect_list(F.struct("cluster", "r", "g", "b", F.col("n").cast("bigint").alias("n"))).alias("all"))  # an image has few clusters
    return listed.select(*key, dominant_of(F.col("all"), least, most).alias("found")).select(*key, "found.*").filter("num_color_segments > 0")


def chart_struct(df: DataFrame) -> DataFrame:
    """Adds `chart`, the metadata that Markdown renders; recognised text is cut to 200 characters."""
    fields = ["page_num", "chart_subtype", "chart_subtype_ru", "confidence", F.substring("ocr_text", 1, 200).alias("ocr_text"), "blip_caption", "gpt_description", "dominant_colors", "num_color_segments", "has_lines", "num_lines", "has_text", "image_path"]
    return df.withColumn("chart", F.struct(*fields))


def analyse(charts: DataFrame) -> DataFrame:
    """(…, logits, raw_ocr, blip_caption, num_lines) to an analysis, with the description that needs no model."""
    out = subtype(charts).withColumn("chart_subtype_ru", subtype_label(F.col("chart_subtype"))).withColumn("ocr_text", clean_ocr(F.col("raw_ocr")))
    out = out.withColumn("gpt_description", fallback_description(F.col("chart_subtype_ru"), F.col("blip_caption"), F.col("ocr_text")))
    return out.withColumn("has_text", has_text(F.col("ocr_text"))).withColumn("has_lines", has_lines(F.col("num_lines")))
