"""PDF files, and readers that a deployment plugs in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 85 * 1024 * 1024


class PdfReader(Protocol):
    """Turns the bytes of a PDF into its pages' texts. Raises for what it can't read."""

    def pages(self, content: bytes) -> list[str]: ...


class PlainPages:
    """A reader for tests: pages are parted by form feeds."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")


def pdf_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(doc_id, content, accepted)`` of the ``.pdf`` files under path (that case only); too large ones have no content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= max_bytes
    return files.select(F.col("path").alias("doc_id"), F.when(fits, F.col("content")).alias("content"), fits.alias("accepted"))


def from_base64(requests: DataFrame) -> DataFrame:
    """``(doc_id, body)`` with base64 bodies; a missing body is not accepted."""
    return requests.select("doc_id", F.unbase64("body").alias("content"), F.col("body").isNotNull().alias("accepted"))


def read_pages(files: DataFrame, reader: PdfReader) -> DataFrame:
    """``(doc_id, page, text, ok, error)``: a row per page from 1, or one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows += [(doc, i, t or "", True, None) for i, t in enumerate(reader.pages(bytes(content)), 1)]
                except Exception as e:  # a document that can't be read is a row of its own
                    rows.append((doc, 0, None, False, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "ok", "error"])

    return files.where("accepted").select("doc_id", "content").mapInPandas(run, "doc_id string, page int, text string, ok boolean, error string")
