"""Validation rules as expressions, grouped by what they look at."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import U, present, strip

# What the rules look for, and (below) the wording of their messages.
SINGLE = U + r"^\d{1,2}$"
STANDARD = r"(?Udi)^(AS/NZS|ISO|IEC|BS|EN)\s+\d+"
TOC_LINE = r"(?Udm)\.{3,}.*\d+\s*$"
LEADERS = U + r"\.{3,}"
FIRST = r"(?Udi)^(1|1\.1|Appendix)"
PROSE = r"(?Udi)\b(shall|must not|must)\b|\bin accordance with\b"
NUMBERED_TITLE = U + r"^\d+(\.\d+)+\s+\S+"


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _issue(type_: str, severity: str, when: Column, message: Column, clause: bool = True) -> Column:
    """The issue of a row, null if there is none."""
    place = F.col("clause_id") if clause else F.lit(None).cast("string")
    return F.when(when, F.struct(F.lit(type_).alias("type"), F.lit(severity).alias("severity"), place.alias("clause_id"), message.alias("message")))


def _issues(frame: DataFrame, rules) -> DataFrame:
    """All issues of some rules, found in one pass over the frame."""
    return frame.select("doc_id", F.explode(F.array_compact(F.array(*(r() for r in rules)))).alias("i")).select("doc_id", "i.*")


def document_counts(clauses: DataFrame) -> DataFrame:
    """The counts that the document-wide rules compare, in one aggregation."""
    yes = lambda c: F.count_if(c)
    return clauses.groupBy("doc_id").agg(
        F.count("*").alias("n"), yes(F.col("clause_number").rlike(SINGLE)).alias("single"),
        yes(F.col("body_with_subitems").rlike(TOC_LINE)).alias("toc"),
        yes((F.col("page_start") == 1) & (F.col("page_end") == 1)).alias("page_one"),
        yes(F.contains(F.col("clause_number"), F.lit("."))).alias("dotted"),
        F.min_by("clause_number", F.struct("page", "line_no")).alias("first_number"),
    )


def with_parents(c: DataFrame) -> DataFrame:
    """The clauses with ``there``: true if a clause of the document has the parent number, else null."""
    numbers = c.select("doc_id", F.col("clause_number").alias("parent_clause_number"), F.lit(True).alias("there")).distinct()
    return c.join(numbers, ["doc_id", "parent_clause_number"], "left")


def missing_parents(c: DataFrame) -> DataFrame:
    """Clauses whose parent number no clause of the document has (an anti join)."""
    numbers = c.select("doc_id", F.col("clause_number").alias("parent_clause_number")).distinct()
    return c.where(present("parent_clause_number")).join(numbers, ["doc_id", "parent_clause_number"], "left_anti")


def _n(name: str) -> Column:
    return F.col(name).cast("string")


# Rules over the counts of a document.


def v01_single_digit():
    message = _text("Too many single-digit clause numbers (", _n("single"), "/", _n("n"), "). Likely parsing page numbers as clauses.")
    return _issue("single_digit_contamination", "error", F.col("single") / F.col("n") > 0.3, message, False)


def v03_toc_contamination():
    return _issue("toc_contamination", "error", F.col("toc") > 0, _text(_n("toc"), " clause(s) contain TOC-style dot leaders. Table of Contents not properly excluded."), False)


def v04_page_tracking():
    message = _text(_n("page_one"), "/", _n("n"), " clauses attributed to page 1. Page tracking may not be working correctly.")
    return _issue("poor_page_tracking", "warning", (F.col("page_one") / F.col("n") > 0.7) & (F.col("n") > 5), message, False)


def v06_poor_hierarchy():
    message = _text("Only ", _n("dotted"), "/", _n("n"), " clauses have hierarchical numbering. Expected more X.X.X style clauses in a structured document.")
    return _issue("poor_hierarchy", "warning", (F.col("dotted") / F.col("n") < 0.3) & (F.col("n") > 10), message, False)


def v07_first_clause():
    return _issue("unexpected_first_clause", "warning", ~F.col("first_number").rlike(FIRST), _text("First clause is '", F.col("first_number"), "', expected '1' or '1.1'"), False)


# Rules over single clauses.


def _clause(*tail) -> Column:
    return _text("Clause ", F.col("clause_number"), *tail)


def v02_header_as_clause():
    found = F.col("clause_number").rlike(SINGLE) & F.col("title").rlike(STANDARD)
    return _issue("header_as_clause", "error", found, _clause(" has standard title '", F.col("title"), "' - likely a header/footer"))


def v05_inconsistent_parent():
    """On the flags as parsed, before other rules change them."""
    fields = present("parent_clause_id") | present("parent_clause_number")
    message = _clause(F.when(F.col("has_parent"), ": has_parent=True but parent fields are null").otherwise(": has_parent=False but parent fields are set"))
    return _issue("inconsistent_parent", "error", F.col("has_parent") != fields, message)


def v08_empty_body():
    return _issue("empty_body", "warning", strip("body_with_subitems") == "", _clause(" has empty body"))


def v09_missing_parent():
    """On :func:`with_parents`."""
    found = present("parent_clause_number") & F.col("there").isNull()
    return _issue("missing_parent", "error", found, _clause(" references non-existent parent ", F.col("parent_clause_number")))


def v10_orphan_note():
    return _issue("orphan_note", "warning", (F.size("notes") > 0) & (strip("body_with_subitems") == ""), _clause(" has notes but no body"))


def v11_toc_in_body():
    return _issue("toc_in_body", "error", F.col("body_with_subitems").rlike(LEADERS), _clause(" body contains TOC-style content (dot leaders)"))


# Rules over single tables.


def _table(*tail) -> Column:
    return _text("Table ", F.coalesce(F.nullif("table_number", F.lit("")), F.col("table_id")), *tail)


def v13_missing_headers():
    return _issue("missing_headers", "warning", F.size("header_rows") == 0, _table(" has no header rows"), False)


def v14_empty_table():
    return _issue("empty_table", "warning", F.size("data_rows") == 0, _table(" has no data rows"), False)


def v15_suspicious_title():
    own = strip("title")
    found = present("title") & ((F.length(own) > 100) | own.rlike(PROSE) | own.rlike(NUMBERED_TITLE))
    short = F.when(F.length("title") <= 100, F.col("title")).otherwise(F.concat(F.substring("title", 1, 97), F.lit("...")))
    return _issue("suspicious_table_title", "warning", found, _table(" title may include clause prose: ", short), False)


# Rules over the rows of a number.


def v12_duplicate_number():
    return _issue("duplicate_number", "error", F.col("count") > 1, _text("Duplicate clause number: ", F.col("clause_number")), False)


def v16_duplicate_table_number():
    message = _text("Table number ", F.col("table_number"), " appears ", _n("count"), " times in output (check merge/dedup)")
    return _issue("duplicate_table_number", "warning", F.col("count") > 1, message, False)


#: What the rules of a group look at, and the rules: each group is one pass, however many rules it has.
CLAUSE_GROUPS = (
    (document_counts, (v01_single_digit, v03_toc_contamination, v04_page_tracking, v06_poor_hierarchy, v07_first_clause)),
    (with_parents, (v02_header_as_clause, v05_inconsistent_parent, v08_empty_body, v09_missing_parent, v10_orphan_note, v11_toc_in_body)),
    (lambda c: c.groupBy("doc_id", "clause_number").count(), (v12_duplicate_number,)),
)
TABLE_GROUPS = (
    (lambda t: t, (v13_missing_headers, v14_empty_table, v15_suspicious_title)),
    (lambda t: t.where(present("table_number")).groupBy("doc_id", "table_number").count(), (v16_duplicate_table_number,)),
)


def _by_name(groups) -> dict:
    return {r.__name__: partial(lambda frame, seen, rule: _issues(seen(frame), [rule]), seen=seen, rule=r) for seen, rules in groups for r in rules}


#: Each rule on its own, by name.
CLAUSE_RULES, TABLE_RULES = _by_name(CLAUSE_GROUPS), _by_name(TABLE_GROUPS)


def clause_issues(c: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [_issues(seen(c), rules) for seen, rules in CLAUSE_GROUPS])


def table_issues(t: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [_issues(seen(t), rules) for seen, rules in TABLE_GROUPS])


def apply_flags(c: DataFrame) -> DataFrame:
    """The clauses with the flags that validation leaves: body, parent that exists, orphan note."""
    blank = strip("body_with_subitems") == ""
    return with_parents(c).withColumns({
        "has_body": F.col("has_body") & ~blank,
        "has_parent": F.col("has_parent") & (~present("parent_clause_number") | F.coalesce("there", F.lit(False))),
        "is_orphan_note": F.col("is_orphan_note") | ((F.size("notes") > 0) & blank),
    }).drop("there")


def summary(issues: DataFrame) -> DataFrame:
    """Per document the number of issues by severity."""
    by = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("doc_id").agg(F.count("*").alias("total_issues"), by("error").alias("errors"), by("warning").alias("warnings"), by("info").alias("info"))
