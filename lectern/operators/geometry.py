"""Range joins between positioned text and regions, and what captions say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.joins import dealt_join
from ..functions.store import kept
from ..functions.text import U, strip

BOX = ("x0", "y0", "x1", "y1")

# Caption patterns in the order in which they are tried.
CAPTIONS = [
    (r"(?Ud)(?i)TABLE\s+([A-Z]?\d+\.\d+)", "table_dotted"),
    (r"(?Ud)(?i)TABLE\s+([A-Z]?\d+)", "table_plain"),
    (U + r"^([A-Z]?\d+\.\d+)\s*[-–—:]", "dotted_dash"),
    (U + r"^([A-Z]?\d+\.\d+)\s+[A-Z]", "dotted_title"),
    (U + r"^([A-Z]?\d+)\s*[-–—:]", "plain_dash"),
]


def native_lines(spans: DataFrame) -> DataFrame:
    """Spans ``(doc_id, page, block, line, seq, text, bbox, size, font)`` to lines: texts joined, the first span's box, the largest size, the first font."""
    key = ["doc_id", "page", "block", "line"]
    return (
        spans.groupBy(*key).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "").alias("text"),
            F.min_by("bbox", "seq").alias("bbox"), F.max("size").alias("font_size"),
            F.coalesce(F.min_by(F.nullif("font", F.lit("")), F.when(F.coalesce("font", F.lit("")) != "", F.col("seq"))), F.lit("")).alias("font_name"),
        ).where(strip("text") != "")
    )


def pdf_type(pages: DataFrame, sample: int = 10, documents: DataFrame | None = None) -> DataFrame:
    """Digital if the first pages hold over 100 characters on average; coverage is a tenth of that, 100 at most.

    documents: all ``doc_id``, so that one without pages (or that can't be read) is there as not digital, coverage 0.
    """
    if documents is not None:
        found = documents.select("doc_id").distinct().join(pdf_type(pages, sample), "doc_id", "left")
        return found.select("doc_id", F.coalesce("is_digital", F.lit(False)).alias("is_digital"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    return (
        pages.where(F.col("page") <= sample).groupBy("doc_id").agg((F.sum(n) / F.count("*")).alias("mean"))
        .select("doc_id", (F.col("mean") > 100).alias("is_digital"), F.least(F.lit(100.0), F.col("mean") / 10).alias("coverage"))
    )


def places(regions: DataFrame, *ids: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, page, ids, place)`` and the boxes of each place once: ids with equal boxes on one page share a place.

    An id that is there several times has all of its boxes, equal ones too.
    """
    at = F.struct("doc_id", "page", F.array_sort(F.collect_list(F.struct(*BOX))).alias("boxes"))
    own = regions.groupBy("doc_id", "page", *ids).agg(at.alias("at"))
    known = kept(own.select("at").distinct().withColumn("place", F.monotonically_increasing_id()))
    boxes = known.select("place", "at.doc_id", "at.page", F.explode("at.boxes").alias("b"))
    return own.join(known, "at").drop("at"), boxes.select("place", "doc_id", "page", *(f"b.{c}" for c in BOX))


def caption_candidates(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines in the band above a table: equal page, then overlapping intervals, ends included."""
    top, low = F.greatest(F.lit(0), F.col("r.y0") - 200), F.col("r.y0") + 50
    vertical = (F.col("l.y0").between(top, low)) | (F.col("l.y1").between(top, low)) | ((F.col("l.y0") <= top) & (F.col("l.y1") >= low))
    sideways = (F.col("l.x1") >= F.col("r.x0") - 100) & (F.col("l.x0") <= F.col("r.x1") + 100)
    lines, tables = lines.select("doc_id", "page", "seq", "text", *BOX).where(strip("text") != ""), tables.select("doc_id", "page", "table_id", *BOX)
    return dealt_join(lines, tables, ["doc_id", "page"], ["seq"], vertical & sideways).select(
        "r.doc_id", "r.page", "r.table_id", "l.seq", "l.text", (F.col("r.y0") - F.col("l.y1")).alias("distance")
    )


def caption_text(candidates: DataFrame, rank: str = "reference", keep: int = 3) -> DataFrame:
    """The texts of the first candidates: farthest first as the reference ranks, or nearest first."""
    far = F.col("distance").desc() if rank == "reference" else F.col("distance").asc()
    rn = F.row_number().over(W.partitionBy("doc_id", "page", "table_id").orderBy(far, "seq"))
    top = candidates.withColumn("rn", rn).where(F.col("rn") <= keep)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda s: s["text"]), " ")
    return top.groupBy("doc_id", "page", "table_id").agg(text.alias("caption"))


def captions(lines: DataFrame, tables: DataFrame, rank: str = "reference", keep: int = 3) -> DataFrame:
    """The texts of each table's first candidates, worked out once for the tables of a page that have equal boxes."""
    own, boxes = places(tables, "table_id")
    text = caption_text(caption_candidates(lines, boxes.withColumnRenamed("place", "table_id")), rank, keep)
    return own.join(text.select(F.col("table_id").alias("place"), "caption"), "place").select("doc_id", "page", "table_id", "caption")


# Patterns of captions that optical readers give, in the order in which they are tried.
READ_CAPTIONS = [
    r"(?Ud)(?i)TABLE\s+([A-Z]?\d+\.?\d*)",
    r"(?Ud)(?i)^([A-Z]?\d+\.?\d*)\s*[-–—]",
    r"(?Ud)(?i)^([A-Z]?\d+\.?\d*)\s+\w",
]


def _first_match(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """Group 1 of the first pattern that a text matches, and what follows the match without the signs that lead it."""
    number, rest = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern in reversed(patterns):
        hit = text.rlike(pattern)
        number = F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(number)
        rest = F.when(hit, F.regexp_extract(text, pattern + r"([\s\S]*)$", 2)).otherwise(rest)
    return number, F.regexp_replace(strip(rest), U + r"^[-–—:\s]+", "")


def parse_caption(c: str = "caption") -> Column:
    """struct(table_number, title) of a caption, null for numbers that look like garbage."""
    number, title = _first_match(F.col(c), [p for p, _ in CAPTIONS])
    title = F.regexp_replace(title, r"(?Ud)(?i)\(continued\)\s*$", "")
    garbage = number.rlike(r"^\d{2,}\.\d{2,}$") & (F.substring_index(number, ".", 1).try_cast("long") > 50)
    found = F.struct(number.alias("table_number"), F.when(F.length(title) > 3, title).alias("title"))
    return F.when(~F.coalesce(garbage, F.lit(False)), found)


def parse_read_caption(c: str = "caption") -> Column:
    """struct(table_number, title) of a caption that an optical reader gave; a title has more than three characters."""
    number, title = _first_match(F.col(c), READ_CAPTIONS)
    return F.struct(number.alias("table_number"), F.when(F.length(title) > 3, title).alias("title"))


def joined_text() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l.seq", "l.text"))), lambda s: s["text"]), " ").alias("text")


def place_text(elements: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(place, text)``: texts of the elements that overlap a place's boxes (touching counts), in element order; places without any are not there."""
    right, bottom = F.col("l.x") + F.col("l.width"), F.col("l.y") + F.col("l.height")
    hit = (F.col("l.x") <= F.col("r.x1")) & (right >= F.col("r.x0")) & (F.col("l.y") <= F.col("r.y1")) & (bottom >= F.col("r.y0"))
    elements = elements.where("seq IS NOT NULL").select("doc_id", "page", "seq", "text", "x", "y", "width", "height")
    return dealt_join(elements, boxes, ["doc_id", "page"], ["seq"], hit).groupBy("r.place").agg(joined_text())


def region_text(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """Texts of the elements that overlap a region (touching counts), in element order."""
    own, boxes = places(regions, "region_id")
    return own.join(place_text(elements, boxes), "place", "left").select("doc_id", "page", "region_id", F.coalesce("text", F.lit("")).alias("text"))


def cell_text(elements: DataFrame, cells: DataFrame) -> DataFrame:
    """Texts of the elements whose centre lies in a cell, ends included."""
    own, boxes = places(cells, "region_id", "row", "column")
    centre = [(F.col("x") + F.col("width") / 2).alias("x"), (F.col("y") + F.col("height") / 2).alias("y")]
    hit = F.col("l.x").between(F.col("r.x0"), F.col("r.x1")) & F.col("l.y").between(F.col("r.y0"), F.col("r.y1"))
    found = dealt_join(elements.select("doc_id", "page", "seq", "text", *centre), boxes, ["doc_id", "page"], ["seq"], hit).groupBy("r.place").agg(joined_text())
    return own.join(found, "place").select("doc_id", "page", "region_id", "row", "column", "text")


def crop_band(y0: str = "y0") -> Column:
    """The band above a table that optical readers get."""
    return F.struct(F.greatest(F.lit(0), F.col(y0) - 100).alias("top"), F.col(y0).alias("bottom"))


def overlay(tables: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Adds ``adobe_text``, ``ocr_source`` and ``adobe_ocr`` (the table has rows) to the tables of pages that were read, joined on the page number."""
    own, boxes = places(tables, "table_id")
    own, found = own.select("doc_id", "table_id", "place"), place_text(elements, boxes)
    read = pages.select("doc_id", "page", F.lit("adobe").alias("ocr_source")).distinct()
    out = tables.join(own, ["doc_id", "table_id"], "left").join(read, ["doc_id", "page"], "left").join(found.withColumnRenamed("text", "adobe_text"), "place", "left")
    rows = [F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("header_rows", "data_rows") if c in tables.columns]
    marked = F.col("ocr_source").isNotNull() & (rows[0] | rows[1] if len(rows) == 2 else F.lit(False))
    text = F.when(F.col("ocr_source").isNotNull() & F.col("place").isNotNull(), F.coalesce("adobe_text", F.lit("")))
    return out.withColumns({"adobe_text": text, "adobe_ocr": marked}).drop("place")
