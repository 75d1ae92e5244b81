"""Optional back ends: PDF parsing, recognition, embedding, captioning, image structure.

Each is loaded on first use in a worker and kept; a failed load is remembered, so later rows skip it. Without a back
end the columns get the documented defaults, and the whole engine runs offline.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "page_num int, block_no int, type int, bbox struct<x0:double,y0:double,x1:double,y1:double>, lines array<struct<spans:array<struct<text:string>>>>"
IMAGES = "page_num int, idx int, xref int, width int, height int, image_hash string, png binary, bbox struct<x0:double,y0:double,x1:double,y1:double>"


class Latch:
    """A worker's one copy of something that is slow to load, or the memory that it would not load."""

    _held: dict[str, object] = {}

    @classmethod
    def get(cls, name: str, load: Callable[[], object]) -> object | None:
        if name not in cls._held:
            try:
                cls._held[name] = load()
            except Exception:
                cls._held[name] = None
        return cls._held[name]


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(source, content) of the files at path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("source"), "content")


def _box(values) -> dict[str, float]:
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, values), strict=True))


def _flat_map(files: DataFrame, schema: str, rows_of: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, content in zip(frame["source"], frame["content"], strict=True):
                rows = [{"source": source} | r for r in rows_of(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows, columns=["source", *names])

    return files.select("source", "content").mapInPandas(run, f"source string, {schema}")


def pdf_blocks(files: DataFrame) -> DataFrame:
    """Raw blocks of PDF files (source, content), for layout.parse_blocks; needs PyMuPDF on the workers."""

    def rows(content: bytes) -> Iterator[dict]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            for page_num, page in enumerate(doc, 1):
                for block_no, b in enumerate(page.get_text("dict")["blocks"]):
                    lines = [{"spans": [{"text": s["text"]} for s in line["spans"]]} for line in b.get("lines", [])]
                    yield {"page_num": page_num, "block_no": block_no, "type": b["type"], "bbox": _box(b["bbox"]), "lines": lines}

    return _flat_map(files, BLOCKS, rows)


def pdf_images(files: DataFrame, least_width: int = 50, least_height: int = 50, least_area: int = 5000) -> DataFrame:
    """Images of PDF files, pages counted from 1; small ones go before they are encoded, and those that fail are left out."""

    def rows(content: bytes) -> Iterator[dict]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            for page_num, page in enumerate(doc, 1):
                boxes = {}
                for info in page.get_image_info(xrefs=True):
                    boxes.setdefault(info.get("xref"), info["bbox"])
                for idx, (xref, *_) in enumerate(page.get_images(full=True)):
                    try:
                        pix = fitz.Pixmap(doc, xref)
                        if pix.width < least_width or pix.height < least_height or pix.width * pix.height < least_area:
                            continue
                        if pix.colorspace is None or pix.colorspace.n != 3 or pix.alpha:
                            pix = fitz.Pixmap(fitz.csRGB, fitz.Pixmap(pix, 0) if pix.alpha else pix)
                        png = pix.tobytes("png")
                    except Exception:
                        continue
                    yield {"page_num": page_num, "idx": idx, "xref": xref, "width": pix.width, "height": pix.height, "image_hash": hashlib.md5(png).hexdigest(), "png": png, "bbox": _box(boxes.get(xref, page.rect))}  # noqa: S324

    return _flat_map(files, IMAGES, rows)


def save_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes each image (name, png) under folder, which all workers must reach, by the last part of its name, and
    returns (name, saved_path)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for frame in frames:
            paths = [f"{base}/{n.rsplit('/', 1)[-1]}" for n in frame["name"]]
            for path, png in zip(paths, frame["png"], strict=True):  # a repeated task writes the same bytes again
                with store.open_output_stream(path) as out:
                    out.write(bytes(png))
            yield pd.DataFrame({"name": frame["name"], "saved_path": paths})

    return images.select("name", "png").mapInPandas(run, "name string, saved_path string")


def image_bytes(path: Column) -> Column:
    """The bytes of image files by path or URI; null for a null path and where there is no such file."""

    @F.pandas_udf("binary")
    def run(part: pd.Series) -> pd.Series:
        from pyarrow import fs

        def one(p):
            try:
                store, base = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p)
                with store.open_input_stream(base, compression=None) as f:
                    return f.read()
            except Exception:
                return None

        return part.map(one)

    return run(path)


def ocr_files(path: Column, languages: str = "rus+eng+kaz", settings: str = "--oem 3 --psm 6") -> Column:
    """Recognised text of image files; empty where a file is missing or no image."""
    return ocr_text(image_bytes(path), languages, settings)


# ------------------------------------------------------------ embeddings


def hash_vectors(texts: list[str], dim: int) -> np.ndarray:
    """Signed hashed counts of each text's words, of length one; the default embedder. Each distinct word is hashed once."""
    split = [t.lower().split() for t in texts]
    word, distinct = pd.factorize(np.array(list(itertools.chain.from_iterable(split)), dtype=object))
    raw = np.frombuffer(b"".join([hashlib.md5(w.encode()).digest()[:5] for w in distinct]), np.uint8).reshape(-1, 5).astype(np.int64)  # noqa: S324
    bucket, sign = (raw[:, :4] @ (256 ** np.arange(3, -1, -1))) % dim, np.where(raw[:, 4] < 128, 1.0, -1.0)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in split])
    counts = np.bincount(row * dim + bucket[word], sign[word], len(texts) * dim).reshape(len(texts), dim)
    length = np.linalg.norm(counts, axis=1, keepdims=True)
    return counts / np.where(length == 0, 1, length)


def vector_rows(matrix: np.ndarray) -> pa.Array:
    """A vector for each row of a matrix; none of them becomes an object of its own."""
    return pa.ListArray.from_arrays(np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1]), matrix.ravel())


def embed_text(text: Column, model: str | None = None, dim: int = 384, batch: int = 32) -> Column:
    """Unit vectors of texts: hashed words, or the named sentence model where it can be loaded."""

    @F.arrow_udf("array<double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def load():
            from sentence_transformers import SentenceTransformer

            return SentenceTransformer(model)

        own = Latch.get(f"text:{model}", load) if model else None
        for part in parts:
            texts = [t or "" for t in part.to_pylist()]
            if own is None:
                yield vector_rows(hash_vectors(texts, dim))
            else:
                yield vector_rows(np.asarray(own.encode(texts, batch_size=batch, normalize_embeddings=True), float).reshape(len(texts), -1))

    return run(text)


def _clip(model: str):
    def load():
        import torch
        from transformers import CLIPModel, CLIPProcessor

        return torch, CLIPModel.from_pretrained(model), CLIPProcessor.from_pretrained(model)

    return Latch.get(f"clip:{model}", load)


def _pictures(part: pd.Series):
    import io

    from PIL import Image

    return [Image.open(io.BytesIO(bytes(p))).convert("RGB") for p in part]


def _unit(rows: np.ndarray) -> list:
    return list(rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12))


def embed_images(png: Column, model: str = "openai/clip-vit-base-patch32") -> Column:
    """Unit vectors of images; null without the model."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = _clip(model)
        for part in parts:
            if held is None:
                yield pd.Series([None] * len(part), dtype=object)
                continue
            torch, net, processor = held
            with torch.no_grad():
                yield pd.Series(_unit(net.get_image_features(**processor(images=_pictures(part), return_tensors="pt")).double().numpy()))

    return run(png)


def embed_image_text(text: Column, model: str = "openai/clip-vit-base-patch32") -> Column:
    """Unit vectors of texts in the images' space; null without the model."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = _clip(model)
        for part in parts:
            if held is None:
                yield pd.Series([None] * len(part), dtype=object)
                continue
            torch, net, processor = held
            with torch.no_grad():
                yield pd.Series(_unit(net.get_text_features(**processor(text=part.fillna("").tolist(), return_tensors="pt", padding=True, truncation=True)).double().numpy()))

    return run(text)


def image_logits(png: Column, prompts: list[str], model: str = "openai/clip-vit-base-patch32") -> Column:
    """Each image's logits for prompts; null without the model, which charts.chart_or_image and charts.subtype take as unknown."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = _clip(model)
        for part in parts:
            if held is None:
                yield pd.Series([None] * len(part), dtype=object)
                continue
            torch, net, processor = held
            with torch.no_grad():
                yield pd.Series(list(net(**processor(text=prompts, images=_pictures(part), return_tensors="pt", padding=True)).logits_per_image.double().numpy()))

    return run(png)


# ------------------------------------------------------------ recognition, captions, structure


def ocr_text(png: Column, languages: str = "rus+eng+kaz", settings: str = "--oem 3 --psm 6") -> Column:
    """Stripped text of images; empty without the back end, for null, and on any error."""

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        def one(p):
            try:
                import pytesseract

                return pytesseract.image_to_string(_pictures(pd.Series([p]))[0], lang=languages, config=settings).strip()
            except Exception:
                return ""

        return part.map(one)

    return run(png)


def ocr_boxes(png: Column, languages: str = "rus+eng+kaz") -> Column:
    """Words with their boxes, for charts.ocr_boxes; none on any error."""
    kind = "array<struct<text:string,x:int,y:int,w:int,h:int,conf:int,block_num:int,line_num:int>>"

    @F.pandas_udf(kind)
    def run(part: pd.Series) -> pd.Series:
        def one(p):
            try:
                import pytesseract

                d = pytesseract.image_to_data(_pictures(pd.Series([p]))[0], lang=languages, output_type=pytesseract.Output.DICT)
                return [
                    {"text": t, "x": d["left"][i], "y": d["top"][i], "w": d["width"][i], "h": d["height"][i], "conf": int(float(d["conf"][i])), "block_num": d["block_num"][i], "line_num": d["line_num"][i]}
                    for i, t in enumerate(d["text"])
                ]
            except Exception:
                return []

        return part.map(one)

    return run(png)


def caption(png: Column, model: str = "Salesforce/blip-image-captioning-base", prompt: str = "This image shows", most: int = 100) -> Column:
    """A caption of each image; empty without the model and on any error."""

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        def load():
            from transformers import BlipForConditionalGeneration, BlipProcessor

            return BlipForConditionalGeneration.from_pretrained(model), BlipProcessor.from_pretrained(model)

        def one(p):
            try:
                net, processor = held
                out = net.generate(**processor(_pictures(pd.Series([p]))[0], prompt, return_tensors="pt"), max_new_tokens=most)
                return processor.decode(out[0], skip_special_tokens=True)
            except Exception:
                return ""

        held = Latch.get(f"caption:{model}", load)
        return part.map(one)

    return run(png)


def pixel_clusters(png: Column, k: int = 5) -> Column:
    """Clusters of an image's colours at 100 by 100 pixels, for charts.dominant_colors; none on any error."""

    @F.pandas_udf("array<struct<cluster:int,r:int,g:int,b:int,n:bigint>>")
    def run(part: pd.Series) -> pd.Series:
        def one(p):
            try:
                rgb = np.asarray(_pictures(pd.Series([p]))[0].resize((100, 100)), np.float64).reshape(-1, 3)
                return [{"cluster": i, "r": int(c[0]), "g": int(c[1]), "b": int(c[2]), "n": int(n)} for i, (c, n) in enumerate(k_means(rgb, k))]
            except Exception:
                return []

        return part.map(one)

    return run(png)


def k_means(points: np.ndarray, k: int, rounds: int = 20, least: float = 1.0, attempts: int = 5, seed: int = 42) -> list[tuple[np.ndarray, int]]:
    """Centres and sizes of the best of several seeded runs; empty clusters are left out."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(attempts):
        centres = points[[rng.integers(len(points))]]
        while len(centres) < k:
            far = ((points[:, None] - centres[None]) ** 2).sum(2).min(1)
            if not far.sum():
                break
            centres = np.vstack([centres, points[rng.choice(len(points), p=far / far.sum())]])
        for _ in range(rounds):
            distance = ((points[:, None] - centres[None]) ** 2).sum(2)
            label = distance.argmin(1)
            moved = np.array([points[label == i].mean(0) if (label == i).any() else c for i, c in enumerate(centres)])
            done = np.abs(moved - centres).max() < least
            centres = moved
            if done:
                break
        cost = distance.min(1).sum()
        if best is None or cost < best[0]:
            best = (cost, centres, np.bincount(label, minlength=len(centres)))
    return [(c, n) for c, n in zip(best[1], best[2], strict=True) if n]


def line_count(png: Column) -> Column:
    """Straight lines of an image; 0 without the back end and on any error."""

    @F.pandas_udf("int")
    def run(part: pd.Series) -> pd.Series:
        def one(p):
            try:
                import cv2

                grey = cv2.cvtColor(np.asarray(_pictures(pd.Series([p]))[0]), cv2.COLOR_RGB2GRAY)
                lines = cv2.HoughLinesP(cv2.Canny(grey, 50, 150), rho=1, theta=np.pi / 180, threshold=50, minLineLength=40, maxLineGap=10)
                return 0 if lines is None else len(lines)
            except Exception:
                return 0

        return part.map(one)

    return run(png)


def project(index: DataFrame, k: int = 2) -> DataFrame:
    """A plane view of the index by principal components (row_id, xy)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = index.select("row_id", array_to_vector("vec").alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(rows).transform(rows).select("row_id", vector_to_array("p").alias("xy"))
