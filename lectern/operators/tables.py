"""Extracted tables: quality filters, normalisation, text form, structure post-processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.joins import dealt_join
from ..functions.text import col, strip, words

CELLS = "array<array<string>>"
# Bullet-like signs and fragments that garbled scans hold.
SIGNS = "•◦▪□■○●◆◇★☆"
GARBLED = ("SWltchboat", "daa", "assreenener")
MIN_DENSITY, MAX_SIMILARITY = 0.1, 0.85
SOURCE_METHOD = "modal_table_transformer_structure"
#: The least width and height of a cell that an optical reader is given.
MIN_CELL = 10


def _rows(c) -> Column:
    return F.coalesce(col(c), F.array().cast(CELLS))


def all_cells(header="header_rows", data="data_rows") -> Column:
    return F.flatten(F.concat(_rows(header), _rows(data)))


def text_density(header="header_rows", data="data_rows") -> Column:
    """Share of cells that are not blank; 0 if there are none."""
    cells = all_cells(header, data)
    filled = F.size(F.filter(cells, lambda x: strip(F.coalesce(x, F.lit(""))) != ""))
    return F.when(F.size(cells) == 0, F.lit(0.0)).otherwise(filled / F.size(cells))


def is_garbled(header="header_rows", data="data_rows") -> Column:
    s = F.array_join(all_cells(header, data), " ", "")
    signs = F.length(s) - F.length(F.translate(s, SIGNS, ""))
    out = (F.contains(s, F.lit("COPYRIGHT")) & (F.length(s) < 100)) | (signs > F.length(s) * 0.3)
    for part in GARBLED:
        out = out | F.contains(s, F.lit(part))
    return out


def cell_match(a: Column, b: Column) -> Column:
    """One cell is part of the other, or more than 0.7 of a's words (counted with repeats) are among b's."""
    shared = F.size(F.array_intersect(F.array_distinct(words(a)), F.array_distinct(words(b))))
    return F.contains(b, a) | F.contains(a, b) | (shared > F.size(words(a)) * 0.7)


def column_similarity(rows: Column, i: Column) -> Column:
    """Mean over rows of whether the cells i and i+1 match; a missing cell is empty."""
    cell = lambda r, k: F.coalesce(F.get(r, k), F.lit(""))
    hits = F.size(F.filter(rows, lambda r: cell_match(cell(r, i), cell(r, i + 1))))
    return hits / F.size(rows)


def similarities(data="data_rows") -> Column:
    """Similarities of adjacent columns, by the width of the first row; none for under two rows or columns."""
    rows = _rows(data)
    width = F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0))
    none = F.array().cast("array<double>")
    return F.when((F.size(rows) < 2) | (width < 2), none).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(width - 2, F.lit(0))), lambda i: column_similarity(rows, i))
    )


def filter_reason() -> Column:
    """The first filter that a raw table fails, or null."""
    number = F.coalesce("table_number", F.lit(""))
    return (
        F.when(F.size(_rows("data_rows")) == 0, "empty")
        .when((F.col("column_count") <= 2) & ((number == "") | number.startswith("MODAL_P")), "narrow")
        .when(text_density() < MIN_DENSITY, "sparse")
        .when(is_garbled(), "garbled")
        .when(F.exists(similarities(), lambda s: s > MAX_SIMILARITY), "duplicate_columns")
    )


def quality_filter(raw: DataFrame) -> DataFrame:
    return raw.where(filter_reason().isNull())


def confidence_band(c="confidence") -> Column:
    v = F.coalesce(col(c), F.lit(0.0))
    return F.when(v >= 0.9, "high").when(v >= 0.7, "medium").otherwise("low")


def table_text(number="table_number", title="title", header="header_rows", data="data_rows") -> Column:
    """``TABLE n``, title, columns of the first header row, and numbered rows, a line each."""
    number, title, header, data = col(number), col(title), _rows(header), _rows(data)
    lines = F.array(
        F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("TABLE "), number)),
        F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("TITLE: "), title)),
        F.when(F.size(header) > 0, F.concat(F.lit("COLUMNS: "), F.array_join(F.get(header, F.lit(0)), " | ", "None"))),
    )
    rows = F.transform(data, lambda r, i: F.concat(F.lit("ROW "), (i + 1).cast("string"), F.lit(": "), F.array_join(r, " | ", "None")))
    return strip(F.array_join(F.concat(F.array_compact(lines), rows), "\n"))


def convert(raw: DataFrame) -> DataFrame:
    """Raw tables to the output's form: place in the page, generated numbers, ids, text."""
    idx = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("pos"))
    number = F.coalesce(F.nullif("table_number", F.lit("")), F.concat(F.lit("MODAL_P"), F.col("page").cast("string"), F.lit("_T"), F.col("idx").cast("string")))
    page = F.col("page").cast("string")
    if "has_merged_cells" not in raw.columns:
        raw = raw.withColumn("has_merged_cells", F.lit(False))
    return (
        raw.withColumn("idx", idx).withColumn("table_number", number)
        .withColumns({
            "table_id": F.concat(F.lit("modal_"), page, F.lit("_"), F.col("idx").cast("string"), F.lit("_"), F.replace(F.col("table_number"), F.lit("."), F.lit("_"))),
            "page_start": F.col("page"), "page_end": F.col("page"), "confidence": confidence_band(),
            "header_rows": _rows("header_rows"), "data_rows": _rows("data_rows"),
            "has_merged_cells": F.coalesce("has_merged_cells", F.lit(False)), "source_method": F.lit(SOURCE_METHOD),
        })
        .withColumns({"normalized_text_representation": table_text(), "has_headers": F.size("header_rows") > 0})
        .select("doc_id", "page", "pos", "idx", "table_id", "table_number", "title", "page_start", "page_end", "confidence", "header_rows", "data_rows", "has_headers", "has_merged_cells", "source_method", "normalized_text_representation")
    )


_MODEL_ROWS = "array<struct<cells:array<string>,is_header:boolean>>"
#: The fields of a table in the order of the output, with their types and what stands where a table has none.
TABLE_FIELDS = {
    "table_id": ("string", None), "table_number": ("string", None), "title": ("string", None), "parent_clause_reference": ("string", None), "parent_clause_id": ("string", None),
    "parent_clause_number": ("string", None), "page_start": ("int", None), "page_end": ("int", None), "header_rows": (_MODEL_ROWS, F.array), "data_rows": (_MODEL_ROWS, F.array),
    "footer_notes": ("array<string>", F.array), "raw_csv": ("string", None), "normalized_text_representation": ("string", None), "confidence": ("string", None), "source_method": ("string", None),
    "extraction_notes": ("array<string>", F.array), "table_key": ("string", None), "continuation_of": ("string", None), "quality_metrics": ("map<string,string>", None),
    "has_headers": ("boolean", lambda: F.lit(True)), "is_multipage": ("boolean", lambda: F.lit(False)), "has_merged_cells": ("boolean", lambda: F.lit(False)),
    "reconstructed_header_rows": (_MODEL_ROWS, None), "promoted_header_rows": (_MODEL_ROWS, None), "final_columns": ("array<string>", None), "header_model": ("map<string,string>", None),
    "reconstruction_confidence": ("string", None), "reconstruction_notes": ("array<string>", None),
}
#: Fields without which, or with a null in which, a row is no table.
REQUIRED = ("table_id", "page_start", "page_end", "normalized_text_representation")


def model(tables: DataFrame) -> DataFrame:
    """Tables with all 28 fields, rows as ``{cells, is_header}``; other columns stay in front."""

    def field(name, kind, default):
        if name not in tables.columns:
            return F.lit(None).cast(kind) if default is None else default().cast(kind)
        own = F.col(name)
        if kind == _MODEL_ROWS and tables.schema[name].dataType.elementType.typeName() == "array":
            own = F.transform(own, lambda r: F.struct(r.alias("cells"), F.lit(name == "header_rows").alias("is_header")))
        return own if default is None else F.coalesce(own, default().cast(kind))

    rest = [c for c in tables.columns if c not in TABLE_FIELDS]
    return tables.select(*rest, *(field(n, k, d).alias(n) for n, (k, d) in TABLE_FIELDS.items()))


def quarantine(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables that have all required fields, a known confidence and cells in every row, and the others with the reason."""
    m = model(tables)
    bad = F.lit(None).cast("string")
    cells = lambda c: F.exists(F.col(c), lambda r: r["cells"].isNull() | F.exists(r["cells"], lambda x: x.isNull()))
    for c in ("header_rows", "data_rows"):
        bad = F.when(cells(c), f"{c}: a cell is missing").otherwise(bad)
    bad = F.when(~F.coalesce("confidence", F.lit("")).isin("high", "medium", "low"), "confidence: unknown").otherwise(bad)
    for c in REQUIRED:
        bad = F.when(F.col(c).isNull(), f"{c}: missing").otherwise(bad)
    m = m.withColumn("reason", bad)
    return m.where("reason IS NULL").drop("reason"), m.where("reason IS NOT NULL")


# --- structure elements ----------------------------------------------------------------------


def structure(elements: DataFrame) -> DataFrame:
    """Elements ``(table_id, label, bbox, confidence)`` to rows by y0, columns by x0, merged-cell flag, mean score and header row count."""
    of = lambda name: F.collect_list(F.when(F.col("label") == name, F.struct(F.col("bbox")[0].alias("x0"), F.col("bbox")[1].alias("y0"), F.col("bbox")[2].alias("x1"), F.col("bbox")[3].alias("y1"))))
    by = lambda c, k: F.array_sort(c, lambda a, b: F.when(a[k] < b[k], -1).when(a[k] > b[k], 1).otherwise(0))
    s = elements.groupBy("table_id").agg(
        by(of("table row"), "y0").alias("rows"), by(of("table column"), "x0").alias("columns"), of("table column header").alias("headers"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"),
    )
    near = F.exists(F.sequence(F.lit(1), F.size("rows") - 1), lambda i: F.abs(F.col("rows")[i]["y0"] - F.col("rows")[i - 1]["y0"]) < 5)
    low = F.array_max(F.transform("headers", lambda h: h["y1"]))
    above = F.size(F.filter("rows", lambda r: r["y0"] < low))
    return s.withColumns({
        "has_merged_cells": F.when(F.size("rows") > 1, near).otherwise(F.lit(False)),
        "header_row_count": F.when(F.size("headers") > 0, F.greatest(F.lit(1), F.least(F.lit(3), above))).otherwise(1),
    })


def cell_grid(structures: DataFrame) -> DataFrame:
    """A row per cell: the crossing of a row's y with a column's x, whole numbers inside the image of ``width`` and ``height``.

    ``readable``: whether the cell is large enough for an optical reader; others are blank.
    """
    low = lambda c: F.greatest(F.lit(0), c.cast("int"))
    high = lambda c, most: F.least(F.col(most).cast("int"), c.cast("int"))
    key = F.struct("table_id").alias("key")  # a table without an id has cells too
    rows = structures.select(key, "table_id", "header_row_count", "height", F.posexplode("rows").alias("row", "r")).select(
        "key", "table_id", "row", (F.col("row") < F.col("header_row_count")).alias("is_header"), low(F.col("r.y0")).alias("y0"), high(F.col("r.y1"), "height").alias("y1")
    ).withColumn("tall", F.col("y1") - F.col("y0") >= MIN_CELL)
    columns = structures.select(key, "width", F.posexplode("columns").alias("column", "c")).select(
        "key", "column", low(F.col("c.x0")).alias("x0"), high(F.col("c.x1"), "width").alias("x1")
    ).withColumn("wide", F.col("x1") - F.col("x0") >= MIN_CELL)
    return dealt_join(rows, columns, ["key"], ["row"]).select("table_id", "row", "column", "is_header", "x0", "y0", "x1", "y1", (F.col("wide") & F.col("tall")).alias("readable"))


def hybrid_cell_text(first: str | Column, second: str | Column, failed: str | Column | None = None) -> Column:
    """The first reader's text, unless it has under two characters and the second found something (not null) or failed: then that, or nothing."""
    a = F.coalesce(strip(col(first)), F.lit(""))
    short = F.length(a) < 2
    lost = F.lit(False) if failed is None else F.coalesce(col(failed), F.lit(False))
    return strip(F.when(short & lost, "").when(short & col(second).isNotNull(), col(second)).otherwise(a))


def fallback_content(lines: DataFrame) -> DataFrame:
    """Lines ``(table_id, seq, text)`` to a header (the first line's words), data rows and counts."""
    kept = lines.where(strip("text") != "")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", words("text").alias("w")))), lambda x: x["w"])
    return kept.groupBy("table_id").agg(rows.alias("rows")).select(
        "table_id", F.slice("rows", 1, 1).alias("header_rows"), F.expr("slice(rows, 2, size(rows))").alias("data_rows"),
        F.size("rows").alias("row_count"), F.array_max(F.transform("rows", F.size)).alias("column_count"),
    )


def caption_cascade(found: DataFrame) -> DataFrame:
    """Per table the first of the native, first and second reader's captions that has a number; else the last attempt's title.

    found: ``table_id`` and structs ``native``, ``trocr``, ``paddle`` of ``(table_number, title)``, null where not tried.
    """
    has = lambda c: F.coalesce(F.col(f"{c}.table_number"), F.lit("")) != ""
    picked = F.when(has("native"), F.col("native")).when(has("trocr"), F.col("trocr")).when(has("paddle"), F.col("paddle"))
    last = F.coalesce("paddle", "trocr", "native")
    method = F.when(has("native"), "native").when(has("trocr"), "trocr").when(has("paddle"), "paddleocr").otherwise("failed")
    return found.select("table_id", method.alias("method"), F.coalesce(picked, last).alias("caption")).select("table_id", "method", "caption.table_number", "caption.title")


def caption_stats(cascade: DataFrame) -> DataFrame:
    return cascade.groupBy("method").count().withColumnRenamed("count", "n")
