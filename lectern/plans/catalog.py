"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as K
from ..operators import clauses as C
from ..operators import geometry as G
from ..operators import linking as J
from ..operators import sinks as S
from ..operators import tables as T
from ..operators import validate as V
from ..sources import detection, fakes, ocr
from ..sources import fixtures as X
from ..sources.fixtures import load
from . import oracles as O
from .structuring import process, tables_only

Query = Callable[[SparkSession, str], DataFrame]
CLAUSE_JSON = ["clause_id", "clause_number", "title", "parent_clause_id", "parent_clause_number", "level", "page_start", "page_end", "body_with_subitems", "notes", "exceptions", "full_normalized_text", "confidence", "has_parent", "has_body", "is_orphan_note"]
COLUMNS = ["doc_id", "page", "line_no", "kind", "clause_id", "clause_number"]


def lines(s, d):
    return X.clause_lines(s, d)


def clauses(s, d):
    return C.clauses(lines(s, d))


def raw(s, d):
    return X.raw_tables(s, d)


def tables(s, d):
    return T.convert(raw(s, d))


def exprs(s, d, name, what):
    return load(s, d, name).selectExpr(*(f"{e} AS {n}" for n, e in what.items()))


def of_clauses(*cols) -> Query:
    return lambda s, d: clauses(s, d).select(*cols)


def of_captions(operator) -> Query:
    return lambda s, d: operator(exprs(s, d, "part", O.CAPTION_LINES), X.regions(s, d).withColumnRenamed("region_id", "table_id"))


def caption_parse(s, d):
    c = of_captions(G.captions)(s, d).withColumn("p", G.parse_caption())
    return c.select("doc_id", "page", "table_id", "p.table_number", "p.title")


def structures(s, d):
    e = exprs(s, d, "part", O.ELEMENT).withColumn("bbox", F.array("x0", "y0", F.col("x0") + 30, F.col("y0") + 20))
    return T.structure(e).withColumns({"width": F.lit(O.IMAGE_SIZE[0]), "height": F.lit(O.IMAGE_SIZE[1])})


def cells(s, d):
    r = X.regions(s, d).withColumn("row", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("column", F.explode(F.array(F.lit(0), F.lit(1))))
    x, y = F.col("x0") + 75 * F.col("column"), F.col("y0") + 40 * F.col("row")
    return r.select("doc_id", "page", "region_id", "row", "column", x.alias("x0"), y.alias("y0"), (x + 75).alias("x1"), (y + 40).alias("y1"))


def cascade(s, d):
    own = lambda c, t: F.struct(F.col(c).alias("table_number"), F.lit(f"{t} title").alias("title"))
    return T.caption_cascade(exprs(s, d, "part", O.CASCADE).select("table_id", own("n", "native").alias("native"), own("t", "trocr").alias("trocr"), own("p", "paddle").alias("paddle")))


def fallback(s, d):
    rows = lines(s, d).select((F.col("doc_id") * 10 + F.col("page")).alias("table_id"), F.col("line_no").alias("seq"), F.col("line").alias("text"))
    bar = lambda c: F.array_join(c, "|")
    return T.fallback_content(rows).select("table_id", bar(F.col("header_rows")[0]).alias("header"), "row_count", "column_count", F.array_join(F.transform("data_rows", bar), ";").alias("data"))


def native(s, d):
    spans = exprs(s, d, "part", O.SPANS).withColumn("bbox", F.struct("x0")).drop("x0")
    return G.native_lines(spans).select("doc_id", "page", "block", "line", "text", "bbox.x0", "font_size", "font_name")


def ocr_results(s, d):
    j = """concat('{"elements":[{"Path":"//p","Text":" ', p_brand, ' ","Bounds":[', p_size, ',2.5,', p_size + 10, ',15],"Font":{"name":"Arial","size":9.5},"Page":', p_size, '},{"Text":"  ","Page":3},{"Text":"no box","Bounds":[1,2],"Page":0}]}')"""
    return load(s, d, "part").selectExpr("p_partkey AS doc_id", f"{j} AS json")


def read_captions(s, d):
    return exprs(s, d, "part", {"p_partkey": "p_partkey", "caption": O.CAPTION_TEXT}).select("p_partkey", G.parse_read_caption().alias("p")).select("p_partkey", "p.*")


def note_coercion(s, d):
    notes = load(s, d, "part").select("p_partkey", C.remarks(F.expr(O.NOTES)).alias("n"), C.remarks(F.expr("CASE WHEN p_size > 25 THEN array(p_name) END"), "Exception").alias("x"))
    shown = lambda c: F.array_join(F.transform(c, lambda r: F.concat(r["type"], F.lit(": "), r["text"])), "|")
    return notes.select("p_partkey", shown("n").alias("notes"), shown("x").alias("exceptions"))


def table_overlay(s, d):
    found = exprs(s, d, "supplier", O.OVERLAID).withColumnRenamed("region_id", "table_id")
    rows = lambda n: F.when(F.col("table_id") % n == 0, F.array(F.array(F.lit("x"))))
    found = found.withColumns({"header_rows": rows(3), "data_rows": rows(4)})
    out = G.overlay(found, X.elements(s, d), X.elements(s, d))
    return out.select("doc_id", "page", "table_id", "adobe_text", "ocr_source", "adobe_ocr")


def ocr_page_sizes(s, d):
    pages = ocr.ocr_pages(ocr_results(s, d))
    return pages.select("doc_id", "page", "width", "height", F.when(F.col("elements").isNull(), 0).otherwise(F.size("elements")).alias("n_elements"))


def _fails(*box):
    raise ValueError("can't read")


def read_by_rule(s, d):
    """Images and regions of the fixture, as a detector would give them."""
    images = X.regions(s, d).select("doc_id", "page").distinct().withColumn("image", F.lit(b"page"))
    found = X.regions(s, d).select("doc_id", "page", F.col("region_id").cast("string").alias("table_id"), *(F.col(c).cast("double").alias(c) for c in detection.BOX))
    return images, found


def caption_run(s, d):
    images, found = read_by_rule(s, d)
    native = exprs(s, d, "part", O.CAPTION_LINES).where("page = 1")
    first = fakes.Ruled(lambda x0, y0, x1, y1: _fails() if x0 % 7 == 0 else f"TABLE {x0}.{y1 % 10}: wide" if x0 % 3 == 0 else None if x0 % 3 == 1 else "no number")
    second = fakes.Ruled(lambda x0, y0, x1, y1: _fails() if y1 % 5 == 0 else f"{x0} - second" if x0 % 2 == 0 else None)
    return detection.caption_run(found, images, native, first, second)


def cell_run(s, d):
    images, _ = read_by_rule(s, d)
    grid = cells(s, d).withColumns({"table_id": F.col("region_id").cast("string"), "is_header": F.col("row") == 0, "readable": (F.col("x0") % 11 != 0)}).withColumns({c: F.col(c).cast("double") for c in detection.BOX})
    first = fakes.Ruled(lambda x0, y0, x1, y1: _fails() if x0 % 7 == 0 else f" a{x0} " if x0 % 3 == 0 else "b")
    second = fakes.Ruled(lambda x0, y0, x1, y1: _fails() if y0 % 5 == 0 else f"c{y0} " if y0 % 2 == 0 else None)
    return detection.cell_run(grid, images, first, second)


def merge_totals(s, d):
    return K.merge_totals(chunk_results(s, d).withColumns({"tables": F.col("chunk_index") % 3, "clauses": F.col("chunk_index") % 7 + 1, "cost_estimate": F.lit(0.056)}))


def gpu_cost(s, d):
    return load(s, d, "part").withColumn("seconds", F.col("p_size") * F.lit(61.0)).select("p_partkey", K.gpu_cost().alias("cost"))


def plan(s, d):
    return K.chunk_plan(X.page_counts(s, d))


def chunk_results(s, d):
    return plan(s, d).select("doc_id", "chunk_index", (F.col("chunk_index") % 5 != 3).alias("success"), (F.col("chunk_index") * 1.5 + 11).alias("processing_time"))


def merged(s, d):
    p = plan(s, d)
    return K.merge_chunks(p.select("doc_id", "chunk_index", (F.abs("doc_id") % 3 + 1).cast("int").alias("page")), p)


def density(s, d):
    return raw(s, d).select("pos", F.round(T.text_density(), 6).alias("density"))


def similarity(s, d):
    sims = T.similarities()
    return raw(s, d).select("pos", F.coalesce(F.round(F.array_max(sims), 6), F.lit(-1.0)).alias("highest"), F.size(sims).alias("pairs"))


def line_stats(s, d):
    pages = load(s, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    rows = C.line_text(C.page_lines(pages)).where("line != ''")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))


def digital(s, d):
    pages = load(s, d, "documents").select((F.col("doc_id") % 50).alias("doc_id"), (F.col("doc_id") / 50).cast("long").alias("page"), "text")
    return G.pdf_type(pages.withColumn("page", F.col("page") + 1))


def run(s, d):
    return process(lines(s, d), raw(s, d))


def issue_rule(rule, source) -> Query:
    return lambda s, d: rule(source(s, d))


def issues(s, d):
    return V.clause_issues(clauses(s, d)).unionByName(V.table_issues(tables(s, d)))


def normalized(s, d):
    c = clauses(s, d)
    return S.normalized_text(C.document_title(c), c, T.convert(T.quality_filter(raw(s, d))))


QUERIES: dict[str, Query] = {
    "clause_lines": lambda s, d: C.line_text(lines(s, d)),
    "classify_lines": lambda s, d: C.classify(lines(s, d)).select("doc_id", "page", "line_no", "kind", "stops"),
    "clause_fields": of_clauses(*COLUMNS, "title"),
    "clause_bodies": of_clauses("doc_id", "page", "line_no", "kind", "body_text"),
    "clause_levels": of_clauses("doc_id", "page", "line_no", "clause_number", "level"),
    "clause_parents": of_clauses("doc_id", "page", "line_no", "clause_number", "parent_clause_number"),
    "letter_bodies": lambda s, d: clauses(s, d).where("kind = 'L'").select("doc_id", "page", "line_no", "clause_number", "body_text"),
    "clause_flags": of_clauses("doc_id", "page", "line_no", "has_parent", "has_body", "is_orphan_note", "confidence"),
    "parent_links": of_clauses("doc_id", "clause_id", "parent_clause_number", "parent_clause_id"),
    "clause_text": of_clauses("doc_id", "clause_id", "full_normalized_text"),
    "clauses_strict": lambda s, d: C.clauses(lines(s, d), "strict").select(*COLUMNS, "title", "parent_clause_number", "parent_clause_id", "level", "body_text", "full_normalized_text"),
    "clause_counts": lambda s, d: clauses(s, d).groupBy("doc_id", "kind").agg(F.count("*").alias("n")),
    **{n: issue_rule(r, X.rule_clauses if n in O.ON_RULE_CLAUSES else clauses) for n, r in V.CLAUSE_RULES.items()},
    **{n: issue_rule(r, tables) for n, r in V.TABLE_RULES.items()},
    "missing_parent_anti": lambda s, d: V.missing_parents(clauses(s, d)).select("doc_id", "clause_id", "clause_number", "parent_clause_number"),
    "issue_summary": lambda s, d: V.summary(issues(s, d)),
    "filter_empty": lambda s, d: raw(s, d).where(T.filter_reason() == "empty").select("pos"),
    "filter_narrow": lambda s, d: raw(s, d).where(T.filter_reason() == "narrow").select("pos"),
    "text_density": density,
    "garbled": lambda s, d: raw(s, d).select("pos", T.is_garbled().alias("garbled")),
    "column_similarity": similarity,
    "quality_filter": lambda s, d: raw(s, d).select("pos", T.filter_reason().alias("reason")),
    "confidence_band": lambda s, d: raw(s, d).select("pos", T.confidence_band().alias("confidence")),
    "table_numbering": lambda s, d: tables(s, d).select("pos", "idx", "table_number", "table_id"),
    "table_text": lambda s, d: tables(s, d).select("pos", "normalized_text_representation"),
    "merged_cells": lambda s, d: structures(s, d).select("table_id", "has_merged_cells", F.size("rows").alias("n_rows"), F.round("confidence", 6).alias("confidence")),
    "header_rows": lambda s, d: structures(s, d).select("table_id", "header_row_count"),
    "cell_grid": lambda s, d: T.cell_grid(structures(s, d)),
    "fallback_content": fallback,
    "caption_cascade": cascade,
    "caption_stats": lambda s, d: T.caption_stats(cascade(s, d)),
    "hybrid_cell_text": lambda s, d: load(s, d, "part").select("p_partkey", T.hybrid_cell_text(F.expr("substr(p_brand, 1, p_size % 4)"), F.expr("CASE WHEN p_size % 3 <> 0 THEN p_name END")).alias("text")),
    "link_prefix": lambda s, d: J.link_prefix(tables(s, d), clauses(s, d)),
    "link_page": lambda s, d: J.link_page(tables(s, d), clauses(s, d)),
    "link_neighbour": lambda s, d: J.link_neighbour(tables(s, d), clauses(s, d)),
    "link_cascade": lambda s, d: J.link_cascade(tables(s, d), clauses(s, d)).select("doc_id", "table_id", "parent_clause_id", "parent_clause_number", "link"),
    "link_stats": lambda s, d: J.link_stats(J.link_cascade(tables(s, d), clauses(s, d))).withColumn("linked_percent", F.round("linked_percent", 6)),
    "caption_candidates": of_captions(G.caption_candidates),
    "caption_top3": of_captions(G.captions),
    "caption_parse": caption_parse,
    "read_caption_parse": read_captions,
    "note_coercion": note_coercion,
    "table_overlay": table_overlay,
    "crop_bands": lambda s, d: X.regions(s, d).select("region_id", G.crop_band().alias("b")).select("region_id", "b.top", "b.bottom"),
    "ocr_pages": ocr_page_sizes,
    "region_text": lambda s, d: G.region_text(X.elements(s, d), X.regions(s, d)),
    "cell_text": lambda s, d: G.cell_text(X.elements(s, d), cells(s, d)),
    "native_lines": native,
    "pdf_type": digital,
    "ocr_elements": lambda s, d: ocr.ocr_elements(ocr_results(s, d)),
    "chunk_plan": plan,
    "split_info": lambda s, d: K.split_info(X.page_counts(s, d)),
    "chunk_metrics": lambda s, d: K.chunk_metrics(chunk_results(s, d)),
    "merge_chunks": merged,
    "merge_totals": merge_totals,
    "gpu_cost": gpu_cost,
    "caption_run": caption_run,
    "cell_run": cell_run,
    "document_title": lambda s, d: C.document_title(clauses(s, d)),
    "normalized_text": normalized,
    "clauses_json": lambda s, d: S.clauses_json(V.apply_flags(clauses(s, d)), CLAUSE_JSON),
    "tables_json": lambda s, d: S.tables_json(run(s, d).tables),
    "job_summary": lambda s, d: run(s, d).summary,
    "tables_only_summary": lambda s, d: tables_only(raw(s, d)).summary,
    "page_line_stats": line_stats,
}
ORACLES = {k: O.ORACLES[k] for k in QUERIES if k in O.ORACLES}
