"""The driver's queries over the testing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions import metrics
from docspark.functions.text import SPACE_CHARS, keywords, text_of
from docspark.functions.vectors import norm
from docspark.operators import charts, chunking, clustered, colour_clusters, generation, images, index, layout, learned_vectors, long_documents, markdown, neighbour_map, patterns, retrieval
from docspark.plans import benchmark, pipeline, shared, sql_functions
from docspark.sources import backends, sinks

ITEM_MARKS = ["• ", "- ", "1. ", "2) ", "– ", "0.52 ", "", "► "]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_blocks(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------ layout and Markdown


def block_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "block_no", "page_num", "block_type")


def block_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.count_types(blocks(spark, sf_dir))


def first_block_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.first_of_each_type(blocks(spark, sf_dir).drop("page_num"), "doc_id", "block_no")


def page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from conversations: a span for each word, lines of five spans, a block for each turn."""
    words = F.split(text_of(F.col("text")), " ")
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 5).cast("int")), lambda i: F.struct(F.transform(F.slice(words, i * 5 + 1, F.lit(5)), lambda w: F.struct(w.alias("text"))).alias("spans")))
    raw = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), (F.col("turn") % 3).alias("type"), lines.alias("lines"))
    return layout.parse_blocks(raw).select("doc_id", "block_no", "block_type", "text")


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(text_of(F.col("html")), F.lit("<li><a [^>]*>([^<]*)</a></li>"), F.lit(1))
    items = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("item_no", "item"))
    return items.withColumn("text", F.concat(F.get(F.array(*[F.lit(m) for m in ITEM_MARKS]), F.col("item_no") % len(ITEM_MARKS)), "item"))


def list_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = list_items(spark, sf_dir).withColumn("block_type", layout.classify(F.col("text")))
    return out.select("page_id", "item_no", "block_type", F.array_join(markdown.list_lines(F.col("text")), "\n").alias("line"))


def table_text() -> Column:
    return F.replace(F.replace(text_of(F.col("text")), F.lit(", "), F.lit("  ")), F.lit(". "), F.lit("\n"))


def table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "block_no", F.array_join(markdown.table_lines(table_text()), "\n").alias("markdown"))


def table_row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = markdown.table_cells(F.replace(F.replace(text_of(F.col("text")), F.lit(", "), F.lit("  ")), F.lit(" the "), F.lit("\t")))
    return blocks(spark, sf_dir).select("doc_id", "block_no", F.size(cells).alias("n_cells"), F.array_join(cells, "|").alias("cells"))


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.build(blocks(spark, sf_dir))


def markdown_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections(built(spark, sf_dir))


def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_markdown(built(spark, sf_dir)).select("doc_id", "section_no", "chunk_no", "section", "page", "type", "text")


def sections_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections, worked out over buckets of blocks and not from a row for each document."""
    return long_documents.sections(blocks(spark, sf_dir))


def chunk_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of chunk_sections over buckets of blocks; of documents beyond a bucket, sections beyond 4000 characters are packed over buckets as well."""
    made = long_documents.chunk_blocks(blocks(spark, sf_dir), whole=4000)
    return made.select("doc_id", "section_no", "chunk_no", "section", "page", "type", "text")


def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(text_of(F.col("text")), F.lit("\n"), F.lit("\n\n")).alias("text"))


def chunk_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_simple(spaced(spark, sf_dir)).select("doc_id", "chunk_no", "text")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.stats(chunking.chunk_simple(spaced(spark, sf_dir)))


def chunk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.histogram(chunking.chunk_simple(spaced(spark, sf_dir)))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for chart analyses, from documents."""
    labels = F.array(*[F.lit(x) for x in charts.SUBTYPES.values()])
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.col("doc_id") % 40 + 1).cast("int").alias("page_num"),
        F.get(labels, (F.col("doc_id") % 9).cast("int")).alias("chart_subtype_ru"),
        text_of(F.col("text")).alias("gpt_description"),
        text_of(F.col("text")).alias("ocr_text"),
        F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("img"), F.col("doc_id").cast("string"), F.lit(".png"))).alias("image_path"),
    )


def chunk_union_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = chunking.chunk_simple(spaced(spark, sf_dir)).select(F.lit(0).alias("branch"), "text", "type", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"))
    pictures = chunking.image_chunks(analyses(spark, sf_dir).drop("doc_id")).select(F.lit(1).alias("branch"), "text", "type", "page", "section")
    return text.unionByName(pictures)


def chart_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analyses(spark, sf_dir)
    return rows.select("doc_id", F.array_join(markdown.chart_lines(F.struct(*rows.columns), F.col("page_num")), "\n").alias("markdown"))


def image_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analyses(spark, sf_dir)
    image = F.struct("image_path", F.when(F.col("doc_id") % 10 == 0, F.lit("other.png")).alias("path"), "ocr_text")
    return rows.select("doc_id", F.array_join(markdown.image_lines(image, F.col("page_num")), "\n").alias("markdown"))


# ------------------------------------------------------------ images


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for images, from documents: equal texts are equal images."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("doc_id"),
        (F.col("doc_id") % 10).cast("int").alias("page_num"),
        F.col("doc_id").alias("idx"),
        F.md5(text_of(F.col("text")).cast("binary")).alias("image_hash"),
        (F.col("n_chars") % 300).cast("int").alias("width"),
        (F.col("n_chars") % 170).cast("int").alias("height"),
    )


def image_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures(spark, sf_dir).filter(images.valid_size(F.col("width"), F.col("height"))).select("doc_id", "idx", "width", "height")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.first_occurrences(pictures(spark, sf_dir)).select("doc_id", "image_hash", "page_num", "idx")


def dedup_limit_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = images.extract(pictures(spark, sf_dir), 20)
    return kept.select("doc_id", "idx", "image_no", images.png_name(F.concat(F.lit("/data/"), "doc_id", F.lit(".pdf")), F.col("page_num") + 1, F.col("image_no")).alias("file_name"))


def image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.summary(images.kept(pictures(spark, sf_dir)))


def image_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first box of (document, page, xref), else the page's: images are embeddings, boxes those of even labels."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("doc_id"), (F.col("vec_id") % 4).cast("int").alias("page_num"), F.col("label").alias("xref"), "vec_id")
    infos = e.filter("xref % 2 = 0").select("doc_id", "page_num", "xref", F.col("vec_id").alias("info_no"), F.concat(F.lit("box"), F.col("vec_id").cast("string")).alias("bbox"))
    pages = e.select("doc_id", "page_num", F.concat(F.lit("page"), F.col("page_num").cast("string")).alias("rect")).distinct()
    return images.with_boxes(e, infos, pages).select("vec_id", "bbox")


def kind_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts, and whatever is no chart, as two branches of one plan."""
    drawn, other = images.split_kinds(zero_shot_2class(spark, sf_dir))
    return drawn.select("vec_id", F.lit(1).alias("branch")).unionByName(other.select("vec_id", F.lit(2).alias("branch")))


# ------------------------------------------------------------ charts


def zero_shot_2class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double") * 10).alias("logits"))
    out = charts.chart_or_image(e)
    return out.select("vec_id", "block_type", F.round("confidence", 4).alias("confidence"), "chart_score", "image_score")


def image_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.count_kinds(zero_shot_2class(spark, sf_dir))


def zero_shot_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double") * 10).alias("logits"))
    out = charts.subtype(e)
    return out.select("vec_id", "chart_subtype", charts.subtype_label(F.col("chart_subtype")).alias("chart_subtype_ru"), F.round("confidence", 4).alias("confidence"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = lambda k: (F.col("vec_id") * k % 256).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("image_no"), mixed(37).alias("r"), mixed(59).alias("g"), mixed(83).alias("b"))


def color_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colours(spark, sf_dir).select("vec_id", charts.color_name(F.col("r"), F.col("g"), F.col("b")).alias("color"))


def dominant_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = colours(spark, sf_dir).withColumn("cluster", (F.floor(F.col("r") / 64) * 4 + F.floor(F.col("g") / 64)).cast("int"))
    out = charts.dominant_colors(charts.color_shares(pixels, "image_no").drop("share"), "image_no")
    return out.select("image_no", F.array_join("dominant_colors", "; ").alias("dominant_colors"), "num_color_segments")


def colour_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of all images clustered together: five seeds and twenty rounds each."""
    return colour_clusters.clusters(colours(spark, sf_dir), "image_no")


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.replace(text_of(F.col("text")), F.lit(" "), F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", charts.clean_ocr(broken).alias("ocr_text"), charts.has_text(charts.clean_ocr(broken)).alias("has_text"))


def ocr_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from conversations: one for each word, its confidence from its place."""
    words = F.split(text_of(F.col("text")), " ")
    boxes = F.transform(words, lambda w, i: F.struct(w.alias("text"), ((i * 17 + F.length(w)) % 100).alias("conf")))
    kept = charts.ocr_boxes(boxes)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(kept).alias("n_boxes"), F.array_join(F.transform(kept, lambda b: b["text"]), " ").alias("words"))


def keyword_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(keywords(F.col("text")), " ").alias("keywords"))


def fallback_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.get(F.array(*[F.lit(x) for x in charts.SUBTYPES.values()]), (F.col("conv_id") % 9).cast("int"))
    caption = F.when(F.col("turn") % 2 == 0, "a chart").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", charts.fallback_description(label, caption, F.col("text")).alias("description"))


def chart_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole analyses: kinds from embeddings, recognised text from documents of the same id."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.replace(text_of(F.col("text")), F.lit(". "), F.lit("\n")).alias("raw_ocr"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double") * 10).alias("logits"))
    rows = e.join(texts, "vec_id").withColumns(
        {
            "blip_caption": F.when(F.col("vec_id") % 2 == 0, "a chart").otherwise(""),
            "num_lines": (F.col("vec_id") % 5).cast("int"),
            "page_num": (F.col("vec_id") % 7).cast("int"),
            "image_path": F.concat(F.lit("c"), F.col("vec_id").cast("string"), F.lit(".png")),
            "dominant_colors": F.array().cast("array<string>"),
            "num_color_segments": F.lit(0),
        }
    )
    c = charts.chart_struct(charts.analyse(rows)).select("vec_id", "chart.*")
    return c.select("vec_id", "page_num", "chart_subtype", "chart_subtype_ru", F.round("confidence", 4).alias("confidence"), "ocr_text", "gpt_description", "has_lines", "has_text", "image_path")


def ordered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's text blocks, then its charts, then its other images, with one number."""
    kinds = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("doc_id"), F.col("vec_id").alias("block_no"), (F.col("vec_id") % 7 + 1).cast("int").alias("page_num"), "label")
    kind = lambda test, name, branch: kinds.filter(test).select("doc_id", "block_no", "page_num", F.lit(name).alias("block_type"), F.lit(branch).alias("branch"))
    text = blocks(spark, sf_dir).select("doc_id", "block_no", "page_num", "block_type")
    every = pipeline.ordered_union(text, kind("label % 2 = 0", "chart", 1), kind("label % 2 = 1", "image", 2))
    return every.select("doc_id", F.col("block_no").cast("int").alias("block_no"), "page_num", "block_type")


# ------------------------------------------------------------ index and retrieval


def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of lengths 0, 1 and 2 to unit vectors; the zero vector stays."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3)).alias("vec"))
    out = index.normalised(e)
    rounded = lambda c: F.round(c, 6) + F.lit(0.0)  # noqa: E731  no minus zero
    return out.select("vec_id", rounded(norm(F.col("vec"))).alias("length"), rounded(F.element_at("vec", 1)).alias("first"), rounded(F.element_at("vec", 64)).alias("last"))


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the embeddings; texts are documents of the same id."""
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), "label")
    kind = F.when(F.col("row_id") % 4 == 0, "image_caption").otherwise("text")
    return index.normalised(e).withColumns({"type": kind, "page": (F.col("row_id") % 5).cast("int"), "section": F.when(F.col("label") == 0, "").otherwise(F.concat(F.lit("S"), F.col("label").cast("string")))})


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 7").first()["embedding"]


def topk_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.retrieve(held(spark, sf_dir), query_vector(spark, sf_dir), 10)
    return best.select("row_id", F.round("score", 4).alias("score"))


def topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.retrieve(held(spark, sf_dir), query_vector(spark, sf_dir), 10, "image_caption")
    return best.select("row_id", "type", F.round("score", 4).alias("score"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k_batch(held(spark, sf_dir), asked(spark, sf_dir), 5).withColumn("score", F.round("score", 4))


def topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of topk_batch over a clustered index, which leaves out what can't be among the best."""
    best, _ = clustered.top_k(clustered.build(held(spark, sf_dir)), asked(spark, sf_dir), 5)
    return best.withColumn("score", F.round("score", 4))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))


def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen nearest others of every vector, equal ones taken together: what the plane view is drawn from."""
    found, _ = neighbour_map.points(vectors(spark, sf_dir))
    return neighbour_map.nearest(found, 15).withColumn("score", F.round("score", 4))


def plane_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as places in a plane where neighbours stay neighbours."""
    return neighbour_map.plane(vectors(spark, sf_dir))


def topk_filtered_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered search for every query: the best 3 k of each, of them the k best of the type."""
    best = retrieval.top_k_batch(held(spark, sf_dir), asked(spark, sf_dir), 30).withColumnRenamed("rank", "place")
    kept = best.join(held(spark, sf_dir).filter("type = 'image_caption'").select("row_id", "type"), "row_id")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).filter("rank <= 10")
    return ranked.select("query_id", "rank", "row_id", "type", F.round("score", 4).alias("score"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.top_k_batch(held(spark, sf_dir), asked(spark, sf_dir), 5)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    chunk = F.substring(F.sha2(F.col("row_id").cast("string").cast("binary"), 256), 1, 8)
    return best.join(held(spark, sf_dir).drop("vec"), "row_id").join(texts, "row_id").withColumn("chunk_id", chunk)


def context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = retrieval.fragment(F.col("rank"), F.col("text"), F.col("page"), F.col("section"), F.col("type"))
    return retrieval.contexts(hits(spark, sf_dir), asked(spark, sf_dir), part)


def context_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = retrieval.fragment(F.col("rank"), F.col("text"), F.col("page"), F.col("section"))
    return retrieval.contexts(hits(spark, sf_dir), asked(spark, sf_dir), part)


def context_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.contexts(hits(spark, sf_dir), asked(spark, sf_dir), retrieval.plain_fragment(F.col("rank"), F.col("text")))


def source_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sources(hits(spark, sf_dir))


def with_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_join(spark, sf_dir).withColumn("question", F.concat(F.lit("Q"), F.col("query_id").cast("string")))


def stub_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = generation.answers(with_question(spark, sf_dir))
    return out.select("query_id", "answer", "model", "context_used", F.col("usage.total_tokens").alias("total_tokens"))


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_question(spark, sf_dir).select("query_id", generation.user_prompt(F.col("context"), F.col("question")).alias("prompt"))


def visual_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_union_images(spark, sf_dir)
    return retrieval.first_visual(rows, ["график", "ДИАГРАММ"], "page", "text").select("page", "text")


def visual_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item of `benchmark` the first document, by id, that holds any of its words of nine letters or more."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower(text_of(F.col("text"))), F.lit(r"\p{L}{9,}"), F.lit(0))).alias("words"))
    words = items.select("item_id", F.explode("words").alias("word"))
    found = patterns.first_holding(table(spark, sf_dir, "documents"), words, "doc_id")
    return found.select("item_id", "doc_id")


def near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What vectors are learned from: for every bucket of words its neighbours, how often they meet, and their mutual information."""
    pairs = shared.stash(learned_vectors.pair_blocks(table(spark, sf_dir, "documents"), 1 << 15), "pairs")  # read twice
    found = learned_vectors.neighbourhoods(pairs, learned_vectors.totals(pairs, 1 << 15))
    return found.withColumn("weight", F.round("weight", 4))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.size(held(spark, sf_dir))


def chunks_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows as chunks of two sources."""
    chunk = F.concat(F.lit("c"), F.col("row_id").cast("string"))
    return held(spark, sf_dir).select(F.when(F.col("row_id") % 2 == 0, "even").otherwise("odd").alias("source"), chunk.alias("chunk_id"), chunk.alias("text"), "type", "page", "section", "vec")


def index_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index saved, appended to and loaded again."""
    rows, path = chunks_held(spark, sf_dir), shared.new_path(spark, "index")
    index.write(rows.filter("source = 'even'"), path)
    index.append(rows.filter("source = 'odd'"), path, 64)
    return index.load(spark, path).select("source", "chunk_id", "type", "page", "section", F.round(norm(F.col("vec")), 6).alias("length"))


def index_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index cleared, and one source appended after that."""
    rows, path = chunks_held(spark, sf_dir), shared.new_path(spark, "index")
    index.write(rows, path)
    index.clear(spark, path)
    index.append(rows.filter("source = 'odd'"), path)
    return index.load(spark, path).select("source", "chunk_id")


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_sources(hits(spark, sf_dir)).select("query_id", "rank", "chunk_id", "text_preview")


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of blocks and of the index after documents have been taken in."""
    made = pipeline.Pipeline(spark, shared.new_path(spark, "index")).ingest(blocks(spark, sf_dir))
    counts = F.array_join(F.array_sort(F.transform(F.map_entries("blocks"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return made.select("index_size", "embedding_dim", "llm_available", "llm_model", counts.alias("blocks"))


# ------------------------------------------------------------ saved results


def markdown_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "markdown")
    sinks.write_markdown(built(spark, sf_dir), path)
    return spark.read.parquet(path)


def results_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "results")
    rows = benchmark.evaluate(exchanges(spark, sf_dir)).select("conv_id", "turn", "bleu", "rouge_l", "faithfulness")
    sinks.write_results(rows, path)
    return spark.read.schema(rows.schema).json(f"{path}/results")


# ------------------------------------------------------------ metrics


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn with the assistant's next turn: the reference and the answer."""
    c = table(spark, sf_dir, "conversations")
    after = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), text_of(F.col("text")).alias("answer"))
    return c.filter("role = 'user'").select("conv_id", "turn", text_of(F.col("text")).alias("reference")).join(after, ["conv_id", "turn"]).withColumn("context_used", generation.context_used(F.col("reference")))


def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges(spark, sf_dir).select("conv_id", "turn", metrics.faithfulness(F.col("answer"), F.col("context_used")).alias("faithfulness"))


def block_classify_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As SQL text over the session's functions; so are the next two."""
    return sql_functions.register(spark).sql(sql_functions.BLOCKS, documents=table(spark, sf_dir, "documents"))


def chunk_sections_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_functions.register(spark).sql(sql_functions.CHUNKS, markdowns=built(spark, sf_dir), spaces=SPACE_CHARS)


def faithfulness_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_functions.register(spark).sql(sql_functions.FAITHFULNESS, exchanges=exchanges(spark, sf_dir))


def bleu2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges(spark, sf_dir).select("conv_id", "turn", metrics.bleu(F.col("reference"), F.col("answer")).alias("bleu"))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges(spark, sf_dir).select("conv_id", "turn", metrics.rouge_l(F.col("reference"), F.col("answer")).alias("rouge_l"))


def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.summary(benchmark.evaluate(exchanges(spark, sf_dir)))


def sample_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample questions, answered by stand-ins: the question itself, with the reference as context."""
    pairs = benchmark.sample_pairs(spark)
    said = pairs.select("query_id", F.concat_ws(" ", "question", "reference").alias("answer"), F.lit("echo").alias("model"), F.col("reference").alias("context_used"))
    return benchmark.run(pairs, said)


def rag_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of `benchmark` over all documents: blocks, Markdown, chunks, hashed embeddings, top-k, context, answer."""
    made = chunking.chunk_markdown(markdown.build(blocks(spark, sf_dir)))
    place = F.md5(F.concat_ws("/", "doc_id", "section_no", "chunk_no").cast("binary"))
    rows = made.withColumns({"vec": backends.embed_text(F.col("text")), "row_id": F.conv(F.substring(place, 1, 15), 16, 10).cast("bigint")})
    rows = shared.stash(rows.select("row_id", "vec", "text", "page", "section", "type"), "chunks")  # read twice, for vectors and for texts
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    best = retrieval.top_k_batch(rows, questions.withColumn("vec", backends.embed_text(F.col("question"))), 5)
    best = shared.stash(best, "best")  # its size is known then, and no text of a chunk has to be shuffled to meet few hits
    found = best.join(rows.drop("vec"), "row_id")
    part = retrieval.fragment(F.col("rank"), F.col("text"), F.col("page"), F.col("section"), F.col("type"))
    context = retrieval.contexts(found, questions, part)
    return generation.answers(questions.join(context, "query_id")).select("query_id", "question", "answer", "model", "context_used")


QUERIES = [
    block_classify, block_type_counts, first_block_per_type, page_parse, list_render, table_row_split, table_render, markdown_build, sections, chunk_sections, sections_long, chunk_long,
    chunk_simple, chunk_stats, chunk_histogram, chunk_union_images, chart_markdown, image_markdown, image_size_filter, dedup_first, dedup_limit_number,
    image_summary, image_boxes, zero_shot_2class, image_kind_counts, zero_shot_argmax, color_name, dominant_share, colour_groups, ocr_lines, ocr_boxes, keyword_list,
    fallback_desc, kind_split, chart_analysis, ordered_blocks, index_cycle, index_cleared, top_sources, ingest_stats, markdown_saved, results_saved, sample_bench, vec_normalize, topk_single, topk_filtered, topk_filtered_batch, topk_batch, topk_pruned, neighbour_graph, plane_map, context_join, context_plain, context_numbered, source_projection, stub_answer,
    prompt_render, visual_chunk, visual_chunks, near_words, index_stats, block_classify_sql, chunk_sections_sql, faithfulness_sql, faithfulness, bleu2, rouge_l, bench_summary, rag_answers,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


