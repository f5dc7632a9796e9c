"""Tables on page images: detector, structure model and optical readers are plugged in, all else is DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import kept
from ..operators import geometry, tables

#: Resolution of page images, and the least scores of a table and of a structure element.
DPI, MIN_TABLE_SCORE, MIN_ELEMENT_SCORE = 300, 0.8, 0.5
BOX = ("x0", "y0", "x1", "y1")


class Rasteriser(Protocol):
    """Turns the bytes of a PDF into ``(width, height, image)`` per page. Raises for what it can't read."""

    def images(self, content: bytes, dpi: int) -> list[tuple[int, int, bytes]]: ...


class Detector(Protocol):
    """Finds tables on a page image: ``(score, box)`` each."""

    def tables(self, image: bytes) -> list[tuple[float, tuple[float, float, float, float]]]: ...


class StructureModel(Protocol):
    """Finds rows, columns and column headers of the table in a box of an image: ``(label, box, score)`` each, in the box's coordinates."""

    def elements(self, image: bytes, box) -> list[tuple[str, tuple[float, float, float, float], float]]: ...


class TextReader(Protocol):
    """Reads the text in a box of an image, as lines (none: nothing found). Raises if it fails."""

    def lines(self, image: bytes, box) -> list[str]: ...


@dataclass
class Models:
    """What a deployment plugs in; all are sent to the workers and load their models there."""

    rasteriser: Rasteriser
    detector: Detector
    structure: StructureModel
    first: TextReader
    second: TextReader


def page_images(files: DataFrame, rasteriser: Rasteriser, dpi: int = DPI) -> DataFrame:
    """``(doc_id, page, width, height, image, error)``: a row per page from 1, or one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows = [(doc, i, w, h, image, None) for i, (w, h, image) in enumerate(rasteriser.images(bytes(content), dpi), 1)]
                except Exception as e:  # a document that can't be read is a row of its own
                    rows = [(doc, 0, 0, 0, None, str(e))]
                yield pd.DataFrame(rows, columns=["doc_id", "page", "width", "height", "image", "error"])

    return files.where("accepted").select("doc_id", "content").mapInPandas(run, "doc_id string, page int, width int, height int, image binary, error string")


def detect(images: DataFrame, detector: Detector, least: float = MIN_TABLE_SCORE) -> DataFrame:
    """``(doc_id, page, pos, table_id, confidence, x0, y0, x1, y1, error)`` of the tables that score above ``least``; a page that fails is a row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, page, image in zip(batch["doc_id"], batch["page"], batch["image"], strict=True):
                try:
                    found = [x for x in detector.tables(bytes(image)) if x[0] > least]
                    rows += [(doc, page, i, f"{doc}#{page}#{i}", float(s), *map(float, box), None) for i, (s, box) in enumerate(found)]
                except Exception as e:
                    rows.append((doc, page, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "pos", "table_id", "confidence", *BOX, "error"])

    schema = "doc_id string, page int, pos int, table_id string, confidence double, x0 double, y0 double, x1 double, y1 double, error string"
    return images.where("error IS NULL").select("doc_id", "page", "image").mapInPandas(run, schema)


def read_boxes(boxes: DataFrame, images: DataFrame, reader: TextReader) -> DataFrame:
    """``(id, lines, failed)`` for boxes ``(doc_id, page, id, x0, y0, x1, y1)``; each page's image goes once to all of its boxes."""
    pages = boxes.groupBy("doc_id", "page").agg(F.collect_list(F.struct("id", *BOX)).alias("boxes")).join(images.select("doc_id", "page", "image"), ["doc_id", "page"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image, own in zip(batch["image"], batch["boxes"], strict=True):
                for b in own:
                    try:
                        rows.append((b["id"], [*reader.lines(bytes(image), tuple(b[k] for k in BOX))], False))
                    except Exception:  # the caller tries another reader
                        rows.append((b["id"], [], True))
            yield pd.DataFrame(rows, columns=["id", "lines", "failed"])

    return pages.select("image", "boxes").mapInPandas(run, "id string, lines array<string>, failed boolean")


def caption_run(found: DataFrame, images: DataFrame, native: DataFrame, first: TextReader, second: TextReader) -> DataFrame:
    """``(table_id, method, table_number, title, attempt)``: native lines, else the first reader, else the second; each reads only what is left.

    ``attempt`` names the last way tried, also where none found a number (``method`` failed).

    native: ``(doc_id, page, seq, text, x0, y0, x1, y1)``, positioned lines of digital documents.
    """
    band = F.struct(F.col("x0"), geometry.crop_band()["top"].alias("y0"), F.col("y0").alias("y1"), F.col("x1"))
    bands = found.select("doc_id", "page", F.col("table_id").alias("id"), band.alias("b")).select("doc_id", "page", "id", *(f"b.{c}" for c in BOX))
    text = geometry.captions(native, found).select("table_id", geometry.parse_caption().alias("native"))
    tried = kept(found.select("table_id").join(text, "table_id", "left"))

    def attempt(tried: DataFrame, name: str, reader: TextReader) -> DataFrame:
        left = tried
        for c in ("native", "trocr")[: 1 if name == "trocr" else 2]:
            left = left.where(F.coalesce(F.col(f"{c}.table_number"), F.lit("")) == "")
        read = read_boxes(bands.join(left.select(F.col("table_id").alias("id")), "id", "left_semi"), images, reader)
        own = read.select(F.col("id").alias("table_id"), F.trim(F.array_join("lines", " ")).alias("caption"), "failed").select("table_id", F.col("failed").alias(f"{name}_failed"), geometry.parse_read_caption().alias(name))
        return kept(tried.join(own, "table_id", "left"))

    every = attempt(attempt(tried, "trocr", first), "paddle", second)
    found = tables.caption_cascade(every)
    failed = every.select("table_id", F.coalesce("paddle_failed", F.lit(False)).alias("lost"))
    last = F.when(F.col("method") == "native", "native_text").when(F.col("method") != "failed", F.col("method")).when(F.col("lost"), "paddleocr_failed").otherwise("paddleocr")
    return found.join(failed, "table_id").select("table_id", "method", "table_number", "title", last.alias("attempt"))


def cell_run(cells: DataFrame, images: DataFrame, first: TextReader, second: TextReader) -> DataFrame:
    """``(table_id, row, column, is_header, text)``: cells read by the first reader, short texts again by the second.

    cells: as :func:`lectern.operators.tables.cell_grid`, with ``doc_id``, ``page`` and boxes in page coordinates.
    """
    cells = cells.withColumn("id", F.concat_ws("|", "table_id", "row", "column"))
    joined = F.array_join("lines", " ")
    one = kept(read_boxes(cells.where("readable"), images, first).select("id", F.trim(joined).alias("first")))
    short = cells.where(F.col("x1") > F.col("x0")).where(F.col("y1") > F.col("y0")).join(one, "id", "left").where(F.length(F.coalesce("first", F.lit(""))) < 2)
    two = read_boxes(short, images, second).select("id", F.when(F.size("lines") > 0, joined).alias("second"), "failed")
    return cells.join(one, "id", "left").join(two, "id", "left").select("table_id", "row", "column", "is_header", tables.hybrid_cell_text("first", "second", "failed").alias("text"))


def contents(found: DataFrame, images: DataFrame, models: Models) -> DataFrame:
    """``(table_id, header_rows, data_rows, row_count, column_count, has_merged_cells)`` of tables; those without structure are read line by line."""
    pages = found.groupBy("doc_id", "page").agg(F.collect_list(F.struct("table_id", *BOX)).alias("boxes")).join(images.select("doc_id", "page", "image"), ["doc_id", "page"])
    model = models.structure

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image, own in zip(batch["image"], batch["boxes"], strict=True):
                for b in own:
                    try:
                        elements = [e for e in model.elements(bytes(image), tuple(b[k] for k in BOX)) if e[2] > MIN_ELEMENT_SCORE]
                    except Exception:  # as a table without structure
                        elements = []
                    rows += [(b["table_id"], label, [*map(float, box)], float(score)) for label, box, score in elements]
            yield pd.DataFrame(rows, columns=["table_id", "label", "bbox", "confidence"])

    elements = pages.select("image", "boxes").mapInPandas(run, "table_id string, label string, bbox array<double>, confidence double")
    size = found.select("table_id", "doc_id", "page", F.col("x0").alias("left"), F.col("y0").alias("top"), F.floor(F.col("x1") - F.col("x0")).cast("int").alias("width"), F.floor(F.col("y1") - F.col("y0")).cast("int").alias("height"))
    shape = kept(tables.structure(elements).join(size, "table_id"))
    whole = shape.where((F.size("rows") > 0) & (F.size("columns") > 0))
    grid = tables.cell_grid(whole).join(size.select("table_id", "doc_id", "page", "left", "top"), "table_id")
    grid = grid.withColumns({c: F.col(c) + F.col("left" if c[0] == "x" else "top") for c in BOX}).drop("left", "top")
    read = cell_run(kept(grid), images, models.first, models.second)
    rows = read.groupBy("table_id", "row", "is_header").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "text"))), lambda c: c["text"]).alias("cells"))
    sorted_rows = lambda header: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_header") == header, F.struct("row", "cells")))), lambda r: r["cells"])
    content = rows.groupBy("table_id").agg(sorted_rows(True).alias("header_rows"), sorted_rows(False).alias("data_rows")).join(
        whole.select("table_id", F.size("rows").alias("row_count"), F.size("columns").alias("column_count")), "table_id"
    )
    bare = found.join(whole.select("table_id"), "table_id", "left_anti").withColumn("id", F.col("table_id"))
    lines = read_boxes(bare, images, models.second).select(F.col("id").alias("table_id"), F.posexplode("lines").alias("seq", "text"))
    every = content.unionByName(tables.fallback_content(lines))
    merged = shape.select("table_id", "has_merged_cells")
    none = F.array().cast(tables.CELLS)
    return found.select("table_id").join(every, "table_id", "left").join(merged, "table_id", "left").select(
        "table_id", F.coalesce("header_rows", none).alias("header_rows"), F.coalesce("data_rows", none).alias("data_rows"), F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("column_count", F.lit(0)).alias("column_count"), F.coalesce("has_merged_cells", F.lit(False)).alias("has_merged_cells"),
    )


def detected_tables(files: DataFrame, models: Models, native: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw tables of all documents, and ``(doc_id, error)`` of the documents that failed, which have no tables."""
    images = kept(page_images(files, models.rasteriser))
    found = kept(detect(images, models.detector))
    errors = kept(images.select("doc_id", "error").unionByName(found.select("doc_id", "error")).where("error IS NOT NULL").groupBy("doc_id").agg(F.min("error").alias("error")))
    good = found.where("error IS NULL").drop("error").join(errors, "doc_id", "left_anti")
    captions, inside = caption_run(good, images, native, models.first, models.second), contents(good, images, models)
    raw = good.join(captions, "table_id").join(inside, "table_id").select(
        "doc_id", "page", "pos", "table_number", "title", "confidence", F.struct(*BOX).alias("bbox"), "header_rows", "data_rows", "row_count", "column_count", "has_merged_cells",
        F.concat(F.lit("hybrid_"), "attempt").alias("extraction_method"),
    )
    return raw, errors
