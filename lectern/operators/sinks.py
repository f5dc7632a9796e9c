"""Output documents: plain text, clause and table JSON, job summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present
from .tables import TABLE_FIELDS, model

RULE, LINE = "=" * 80, "-" * 80
#: Keys of a table that are left out when null.
RECONSTRUCTION = ("reconstructed_header_rows", "promoted_header_rows", "final_columns", "header_model", "reconstruction_confidence", "reconstruction_notes")


def _lines(*parts) -> Column:
    return F.array_join(F.array_compact(F.array(*(p if isinstance(p, Column) else F.lit(p) for p in parts))), "\n")


def _field(name: str, value: str) -> Column:
    return F.when(present(value), F.concat(F.lit(f"{name}: "), F.col(value)))


def _remarks(c: str, head: str, text) -> Column:
    """The head and a line for each entry, and a blank line; null for an empty list."""
    return F.when(F.size(c) > 0, F.concat(F.lit(f"{head}:\n"), F.array_join(F.transform(c, lambda n: F.concat(F.lit("  * "), text(n))), "\n"), F.lit("\n")))


def clause_block() -> Column:
    """A clause's lines, without the line feed after the last."""
    remark = lambda c, head: _remarks(c, head, lambda n: F.concat(n["type"], F.lit(": "), n["text"]))
    return _lines(
        "[CLAUSE]", F.concat(F.lit("Number: "), "clause_number"), _field("Title", "title"), _field("Parent", "parent_clause_number"),
        F.concat(F.lit("Level: "), F.col("level").cast("string")), F.concat_ws("", F.lit("Pages: "), "page_start", F.lit("-"), "page_end"),
        F.concat(F.lit("Confidence: "), "confidence"), "", "Body:", F.coalesce("body_with_subitems", F.lit("")), "",
        remark("notes", "Notes"), remark("exceptions", "Exceptions"), LINE, "",
    )


def table_block() -> Column:
    return _lines(
        "[TABLE]", _field("Number", "table_number"), _field("Title", "title"), _field("Parent Clause", "parent_clause_reference"), F.concat_ws("", F.lit("Pages: "), "page_start", F.lit("-"), "page_end"),
        F.concat(F.lit("Confidence: "), "confidence"), "", F.col("normalized_text_representation"), "", _remarks("footer_notes", "Footer Notes", lambda n: n), LINE, "",
    )


def _collected(block: Column, *order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, block.alias("b")))), lambda x: x["b"]), "\n")


def normalized_text(titles: DataFrame, clauses: DataFrame, tables: DataFrame) -> DataFrame:
    """``(doc_id, text)`` for each titled document."""
    c = clauses.groupBy("doc_id").agg(_collected(clause_block(), "page", "line_no").alias("c"))
    t = model(tables).groupBy("doc_id").agg(_collected(table_block(), "page", "pos").alias("t"))
    head = _lines(RULE, F.concat(F.lit("DOCUMENT TITLE: "), "document_title"), RULE, "", "CLAUSES", RULE, "")
    text = _lines(head, F.col("c"), F.when(F.col("t").isNotNull(), _lines("", "TABLES", RULE, "", F.col("t"))))
    return titles.join(c, "doc_id", "left").join(t, "doc_id", "left").select("doc_id", text.alias("text"))


def clauses_json(clauses: DataFrame, fields: list[str]) -> DataFrame:
    """``(doc_id, json)``: the clauses in document order, nulls kept."""
    one = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return clauses.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", one.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("json"))


def tables_json(tables: DataFrame) -> DataFrame:
    """``(doc_id, json)``: as for clauses, with all fields of a table, but reconstruction keys that are null are left out."""
    plain = F.to_json(F.struct(*(f for f in TABLE_FIELDS if f not in RECONSTRUCTION)), {"ignoreNullFields": "false"})
    own = F.to_json(F.struct(*RECONSTRUCTION), {"ignoreNullFields": "true"})
    one = F.when(own == "{}", plain).otherwise(F.concat(F.regexp_replace(plain, r"\}$", ","), F.substring(own, 2, 1 << 30)))
    return model(tables).groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", one.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("json"))


def write_outputs(titles: DataFrame, clauses: DataFrame, tables: DataFrame, clause_fields: list[str], path: str) -> None:
    """Writes the three outputs under path, each a folder of JSON lines ``{doc_id, value}``: as many files as there are tasks, not documents."""
    for name, frame, column in (
        ("normalized_document", normalized_text(titles, clauses, tables), "text"),
        ("clauses", clauses_json(clauses, clause_fields), "json"), ("tables", tables_json(tables), "json"),
    ):
        frame.select("doc_id", F.col(column).alias("value")).write.mode("overwrite").json(f"{path}/{name}")


def job_summary(titles: DataFrame, clauses: DataFrame, tables: DataFrame, issues: DataFrame) -> DataFrame:
    n = lambda d, k: d.groupBy("doc_id").agg(F.count("*").alias(k))
    from .validate import summary

    out = titles.join(n(clauses, "total_clauses"), "doc_id", "left").join(n(tables, "total_tables"), "doc_id", "left").join(summary(issues), "doc_id", "left")
    return out.na.fill(0, ["total_clauses", "total_tables", "total_issues", "errors", "warnings", "info"])
