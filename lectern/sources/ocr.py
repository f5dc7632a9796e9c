"""OCR results as JSON to positioned elements."""

from __future__ import annotations

import io
import json
import time
import zipfile
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

SCHEMA = "elements array<struct<Path:string,Text:string,Bounds:array<double>,Font:struct<name:string,size:double>,Page:int>>"
PAGE_WIDTH, PAGE_HEIGHT = 612, 792


def ocr_elements(results: DataFrame, page_offset: int = 0) -> DataFrame:
    """``(doc_id, json)`` to a row per element that has text; four bounds give a box, others zeros."""
    e = results.select("doc_id", F.posexplode(F.from_json("json", SCHEMA)["elements"]).alias("seq", "e"))
    b = F.col("e.Bounds")
    box = lambda c: F.when(F.size(b) == 4, c).otherwise(F.lit(0.0))
    return e.select(
        "doc_id", (F.coalesce("e.Page", F.lit(0)) + 1 + page_offset).alias("page"), "seq", strip(F.coalesce("e.Text", F.lit(""))).alias("text"),
        box(b[0]).alias("x"), box(b[1]).alias("y"), box(b[2] - b[0]).alias("width"), box(b[3] - b[1]).alias("height"),
        F.coalesce("e.Font.name", F.lit("")).alias("font"), F.coalesce("e.Font.size", F.lit(0.0)).alias("font_size"),
    ).where("text != ''")


def ocr_pages(results: DataFrame, page_offset: int = 0) -> DataFrame:
    """The pages that any element is on, with their elements in order; a page of blanks has none."""
    e = results.select("doc_id", F.explode(F.from_json("json", SCHEMA)["elements"]).alias("e"))
    pages = e.select("doc_id", (F.coalesce("e.Page", F.lit(0)) + 1 + page_offset).alias("page")).distinct()
    own = ocr_elements(results, page_offset).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "x", "y", "width", "height", "font", "font_size"))).alias("elements"))
    return pages.join(own, ["doc_id", "page"], "left").select("doc_id", "page", F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"), "elements")


class ChunkReader(Protocol):
    """Reads pages page_start to page_end of a document and gives their elements as JSON. Raises if the chunk can't be read."""

    def read(self, doc_id, page_start: int, page_end: int) -> str: ...


def read_chunks(plan: DataFrame, reader: ChunkReader) -> DataFrame:
    """A row per chunk of the plan: ``success``, ``json``, ``error``, ``processing_time``; a chunk that fails stops no other.

    Chunks are rows, so those of one document are read side by side.
    """
    names = ["doc_id", "chunk_index", "page_start", "success", "json", "error", "processing_time"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, chunk, first, last in zip(batch["doc_id"], batch["chunk_index"], batch["page_start"], batch["page_end"], strict=True):
                began = time.monotonic()
                try:
                    got = (True, reader.read(doc, int(first), int(last)), None)
                except Exception as e:  # a failed chunk is a row of its own
                    got = (False, None, str(e))
                out.append((doc, chunk, first, *got, time.monotonic() - began))
            yield pd.DataFrame(out, columns=names)

    kind = plan.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, chunk_index int, page_start int, success boolean, json string, error string, processing_time double"
    return plan.select("doc_id", "chunk_index", "page_start", "page_end").mapInPandas(run, schema)


def chunk_elements(results: DataFrame) -> DataFrame:
    """The elements of the chunks that were read, their pages counted from the document's first."""
    own = results.where("success").select(F.struct("doc_id", "chunk_index", F.col("page_start").alias("first")).alias("doc_id"), "json")
    found = ocr_elements(own)
    return found.select("doc_id.doc_id", "doc_id.chunk_index", (F.col("page") + F.col("doc_id.first") - 1).alias("page"), *found.columns[2:])


def failure_reason(error: str = "error"):
    return F.when(F.contains(F.lower(F.coalesce(F.col(error), F.lit(""))), F.lit("disqualified")), "adobe_api_limit").otherwise("adobe_error")


#: The entry of a result archive that holds the elements.
RESULT_ENTRY = "structuredData.json"


def result_text(body: bytes | str | None, archive: bytes | None) -> str:
    """The JSON text of a service's answer: its body if that is text, else the archive's entry. Raises if neither is a JSON object."""
    if body is None or isinstance(body, (bytes, bytearray)):
        if archive is None:
            raise ValueError("the service returned no content or resource")
        with zipfile.ZipFile(io.BytesIO(archive)) as z:
            body = z.read(RESULT_ENTRY).decode("utf-8")
    if not isinstance(json.loads(body), dict):
        raise ValueError("the service returned an unexpected type of data")
    return body


def read_results(answers: DataFrame) -> DataFrame:
    """``(doc_id, body, archive, error)``: the answer as text (null: none), its ZIP archive, and the service's own error.

    Gives ``(doc_id, success, json, error, fallback_reason)``: an answer that can't be read is a row with the error, as is a failure of the service.
    """
    kind = answers.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, body, archive, error in zip(batch["doc_id"], batch["body"], batch["archive"], batch["error"], strict=True):
                try:
                    if error:
                        raise ValueError(error)
                    out.append((doc, True, result_text(body, None if archive is None else bytes(archive)), None))
                except Exception as e:  # an answer that can't be read is a row of its own
                    out.append((doc, False, None, str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "success", "json", "error"])

    read = answers.select("doc_id", "body", "archive", "error").mapInPandas(run, f"doc_id {kind}, success boolean, json string, error string")
    return read.withColumn("fallback_reason", F.when(~F.col("success"), failure_reason()))
