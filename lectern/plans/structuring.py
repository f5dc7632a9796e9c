"""Whole runs over many documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import kept
from ..operators import chunks, geometry, linking, sinks, tables, validate
from ..operators import clauses as C
from ..sources import detection, files, ocr

#: Seconds of work and dollars that a document without chunks costs to read.
COST_PER_DOCUMENT = 0.05


@dataclass
class Result:
    clauses: DataFrame
    tables: DataFrame
    issues: DataFrame
    titles: DataFrame
    summary: DataFrame
    text: DataFrame
    #: Rows that are no tables, with the reason.
    rejected: DataFrame


def process(lines: DataFrame, raw_tables: DataFrame, dialect: str = "deployed") -> Result:
    """Clauses, filtered and linked tables, issues, titles, summary and text of every document.

    Clauses and linked tables are computed once and kept; all else is lazy and reads them.
    """
    return assemble(C.clauses(lines, dialect), raw_tables, lines.select("doc_id"))


def assemble(clauses: DataFrame, raw_tables: DataFrame, documents: DataFrame) -> Result:
    """The same from clauses that are there already; documents: their ``doc_id``, to which those with tables are added."""
    found = kept(C.with_remarks(clauses))
    good, rejected = tables.quarantine(tables.convert(tables.quality_filter(raw_tables)))
    linked = kept(linking.link_cascade(good.drop("parent_clause_id", "parent_clause_number"), found))
    issues = validate.clause_issues(found).unionByName(validate.table_issues(linked))
    docs = documents.union(raw_tables.select("doc_id")).distinct()
    titles = docs.join(C.document_title(found), "doc_id", "left").na.fill("Technical Standard Document", ["document_title"])
    flagged = validate.apply_flags(found)
    return Result(flagged, linked, issues, titles, sinks.job_summary(titles, flagged, linked, issues), sinks.normalized_text(titles, flagged, linked), rejected)


def tables_only(raw_tables: DataFrame) -> Result:
    """The tables' path: filtered tables, no clauses, no links, table issues only, no title."""
    out, rejected = tables.quarantine(tables.convert(tables.quality_filter(raw_tables)))
    issues = validate.table_issues(out)
    titles = raw_tables.select("doc_id").distinct().withColumn("document_title", F.lit(None).cast("string"))
    none = titles.limit(0)
    return Result(none, out, issues, titles, sinks.job_summary(titles, none, out, issues), none, rejected)


@dataclass
class Readers:
    """What a deployment plugs in: page texts, positioned lines, models on images, and optionally an OCR service."""

    text: files.PdfReader
    models: detection.Models
    #: ``files -> (doc_id, page, seq, text, x0, y0, x1, y1)``, the positioned lines of digital documents.
    native: object
    service: ocr.ChunkReader | None = None


def extract_complete(found: DataFrame, readers: Readers, dialect: str = "deployed") -> tuple[Result, DataFrame]:
    """From files ``(doc_id, content, accepted)`` to all outputs, and ``(doc_id, success, error, table_count, clause_count, ocr_pages, cost_estimate)``.

    A document whose tables can't be read has failed and gives nothing; one whose text can't be read
    keeps its tables and is a partial success, with the error. Chunks of the OCR service that fail, or
    all of them, leave the tables as the models read them.
    """
    pages = kept(files.read_pages(found, readers.text))
    raw, lost = detection.detected_tables(found, readers.models, readers.native(found))
    raw = kept(raw)
    unread = pages.where("NOT ok").groupBy("doc_id").agg(F.min("error").alias("why"))
    good = pages.where("ok").join(lost, "doc_id", "left_anti")
    ids = found.where("accepted").select("doc_id")
    sizes = good.groupBy("doc_id").agg(F.max("page").alias("total_pages"))
    costs = sizes.select("doc_id", F.lit(0).alias("ocr_pages"), F.lit(0.0).alias("cost"))
    if readers.service is not None:
        read = kept(ocr.read_chunks(chunks.chunk_plan(sizes), readers.service))
        elements = ocr.chunk_elements(read)
        seen = kept(elements.select("doc_id", "page").distinct())
        boxes = raw.withColumn("table_id", F.concat_ws("#", "doc_id", "page", "pos")).withColumns({c: F.col(f"bbox.{c}") for c in detection.BOX})
        raw = kept(geometry.overlay(boxes, seen, elements.where("width > 0 OR height > 0")).drop("table_id", *detection.BOX))
        costs = chunks.chunk_metrics(read).join(seen.groupBy("doc_id").agg(F.count("*").alias("ocr_pages")), "doc_id", "left").select(
            "doc_id", F.coalesce("ocr_pages", F.lit(0)).alias("ocr_pages"),
            F.when(F.col("num_chunks") > 1, F.col("total_cost")).otherwise(F.when(F.col("success"), COST_PER_DOCUMENT).otherwise(0.0)).alias("cost"),
        )
    out = assemble(C.clauses(C.page_lines(good), dialect), raw, ids.join(lost, "doc_id", "left_anti"))
    n = lambda d, k: d.groupBy("doc_id").agg(F.count("*").alias(k))
    status = ids.distinct().join(lost, "doc_id", "left").join(unread, "doc_id", "left")
    status = status.join(n(out.tables, "table_count"), "doc_id", "left").join(n(out.clauses, "clause_count"), "doc_id", "left").join(costs, "doc_id", "left")
    error = F.coalesce("error", F.concat(F.lit("Clauses extraction failed: "), "why"))
    return out, status.select(
        "doc_id", F.col("error").isNull().alias("success"), error.alias("error"), F.coalesce("table_count", F.lit(0)).alias("table_count"), F.coalesce("clause_count", F.lit(0)).alias("clause_count"),
        F.coalesce("ocr_pages", F.lit(0)).alias("ocr_pages"), F.coalesce("cost", F.lit(0.0)).alias("cost_estimate"),
    )
