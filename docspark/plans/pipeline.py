"""Ingest and query as lazy plans over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.operators import charts, chunking, generation, images, index, layout, markdown, retrieval
from docspark.plans.shared import stash
from docspark.sources import backends


def image_blocks(found: DataFrame, endpoint: generation.Endpoint | None = None, ledger: str | None = None) -> DataFrame:
    """Blocks of images (doc_id, page_num, idx, png, image_path): charts with their analysis, then other images.

    With an endpoint that can be used charts are described by it.

    Order is by branch: charts follow all text, and other images follow charts.
    """
    kinds = charts.chart_or_image(found.withColumn("logits", backends.image_logits(F.col("png"), charts.CHART_PROMPTS + charts.IMAGE_PROMPTS)))
    drawn, other = images.split_kinds(stash(kinds, "kinds"))  # read by both branches
    read = drawn.withColumn("logits", backends.image_logits(F.col("png"), list(charts.SUBTYPES))).withColumn("raw_ocr", backends.ocr_text(F.col("png"))).withColumn("blip_caption", backends.caption(F.col("png"))).withColumn("num_lines", backends.line_count(F.col("png")))
    coloured = read.withColumn("clusters", backends.pixel_clusters(F.col("png"))).withColumn("colours", charts.dominant_of(F.col("clusters")))
    analysed = charts.analyse(coloured).withColumns({c: F.col(f"colours.{c}") for c in ("dominant_colors", "num_color_segments")}).drop("clusters", "colours", "png", "logits")
    analysed = generation.describe_charts(analysed, endpoint, ledger)
    chart = charts.chart_struct(analysed).select("doc_id", F.col("idx").alias("block_no"), "page_num", F.lit("chart").alias("block_type"), chunking.chart_text(F.struct("chart_subtype_ru", "page_num", "gpt_description", "ocr_text")).alias("text"), "chart", F.lit(1).alias("branch"))
    photo = other.select("doc_id", F.col("idx").alias("block_no"), "page_num", F.lit("image").alias("block_type"), F.lit(None).cast("string").alias("text"), F.struct("image_path", F.lit(None).cast("string").alias("path"), backends.ocr_text(F.col("png")).alias("ocr_text")).alias("image"), F.lit(2).alias("branch"))
    return chart.unionByName(photo, allowMissingColumns=True)


def ordered_union(*parts: DataFrame, by_page: bool = False) -> DataFrame:
    """All parts' blocks with one block_no: part after part, or by page where asked for."""
    every = parts[0].withColumn("branch", F.lit(0))
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    later_page = F.when(F.col("branch") > 0, F.col("page_num"))  # the first part is in order as it is
    keys = ["page_num", "branch", "block_no"] if by_page else ["branch", later_page, "block_no"]
    return every.withColumn("block_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys)) - 1).drop("branch")


@dataclass
class Pipeline:
    """path: where the index lies. Nothing runs before a result is asked for, but for what ingest saves."""

    spark: SparkSession
    path: str
    embedder: str | None = None
    dim: int = 384
    top_k: int = 5
    most: int = 1000
    overlap: int = 100
    least: int = 50
    endpoint: generation.Endpoint = field(default_factory=generation.Endpoint)
    ledger: str | None = None  # a folder for what the endpoint has said

    def chunks(self, blocks: DataFrame) -> DataFrame:
        """Blocks to embedded chunks."""
        made = chunking.chunk_markdown(markdown.build(blocks), self.most, self.overlap, self.least)
        return made.withColumn("source", F.col("doc_id").cast("string")).withColumn("vec", backends.embed_text(F.col("text"), self.embedder, self.dim))

    def ingest(self, blocks: DataFrame, mode: str = "append") -> DataFrame:
        """Adds blocks of any number of documents to the index, and returns the counts of what is in it now."""
        index.write(self.chunks(blocks), self.path, mode, self.dim if self.embedder is None else None)
        counts = layout.count_types(blocks).agg(F.map_from_entries(F.collect_list(F.struct("block_type", "n"))).alias("blocks"))
        return self.get_stats().join(counts, F.lit(True))  # two rows of totals

    def ingest_pdfs(self, path: str, process_images: bool = True, most_images: int | None = None, image_dir: str | None = None) -> DataFrame:
        """Reads the PDF files at path into the index. With image_dir (a URI that all workers reach) their images are
        saved there, under the names that Markdown links to."""
        files = backends.read_files(self.spark, path)
        doc = F.col("source").alias("doc_id")
        text = layout.parse_blocks(backends.pdf_blocks(files)).select(doc, "block_no", "page_num", "block_type", "text")
        if not process_images:
            return self.ingest(stash(ordered_union(text), "blocks"))
        found = images.extract(backends.pdf_images(files).withColumnRenamed("source", "doc_id"), most_images)
        named = stash(found, "images").withColumn("image_path", images.png_name(F.col("doc_id"), F.col("page_num"), F.col("image_no")))
        if image_dir:
            named = named.withColumn("image_path", F.concat(F.lit(image_dir.rstrip("/") + "/"), "image_path"))
            backends.save_images(named.select(F.col("image_path").alias("name"), "png"), image_dir).count()
        return self.ingest(stash(ordered_union(text, image_blocks(named, self.endpoint, self.ledger)), "blocks"))  # for chunks and counts

    def query(self, questions: DataFrame, k: int | None = None, source: str | None = None) -> tuple[DataFrame, DataFrame]:
        """questions (query_id, question) to (answers, sources)."""
        try:
            held = index.load(self.spark, self.path)
        except FileNotFoundError:
            nothing = self.spark.createDataFrame([], "query_id bigint, rank int, chunk_id string, score double, page int, section string, chunk_type string, text_preview string")
            return generation.no_index(questions), nothing
        if source is not None:
            held = held.filter(F.col("source") == source)
        asked = questions.withColumn("vec", backends.embed_text(F.col("question"), self.embedder, self.dim))
        best = retrieval.top_k_batch(held, asked, k or self.top_k)
        hits = best.join(held.drop("vec"), "row_id")
        part = retrieval.fragment(F.col("rank"), F.col("text"), F.col("page"), F.col("section"), F.col("type"))
        context = retrieval.contexts(hits, questions, part)
        return generation.answers(questions.join(context, "query_id"), self.endpoint, self.ledger), retrieval.sources(hits)

    def get_stats(self) -> DataFrame:
        """One row about the index and the endpoint."""
        try:
            counts = index.size(index.load(self.spark, self.path))
        except FileNotFoundError:
            counts = self.spark.range(1).select(F.lit(0).cast("bigint").alias("index_size"), F.lit(self.dim).alias("embedding_dim"))
        return counts.select(F.lit(self.path).alias("index_dir"), "index_size", F.coalesce("embedding_dim", F.lit(self.dim)).alias("embedding_dim"), F.lit(self.endpoint.available()).alias("llm_available"), F.lit(self.endpoint.model).alias("llm_model"))
