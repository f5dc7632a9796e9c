"""Clause segmentation as window functions: lines to a numbered hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.store import kept
from ..functions.text import U, col, dots, last_part_dropped, strip

# The grammar of clause starts and of the lines that end a body.
NUMBERED = U + r"^(\d+(?:\.\d+)*)\s+([A-Z][^\n]+)$"
APPENDIX = r"(?Udi)^APPENDIX\s+([A-Z](?:\.\d+)*)\s*[-–—:]*\s*([^\n]*)$"
LETTER = U + r"^\(([a-z])\)\s+(.+)$"
ROMAN = r"(?Udi)^\((i{1,3}|iv|v|vi{0,3}|ix|x)\)\s+(.+)$"
NOTE = U + r"^NOTES?:\s*.+"
EXCEPTION = U + r"^EXCEPTIONS?:\s*.+"
NUMBERED_STOP = U + r"^\d+(?:\.\d+)*\s+[A-Z]"
APPENDIX_STOP = r"(?Udi)^APPENDIX\s+[A-Z]"
LETTER_STOP = U + r"^\([a-z]\)\s+"
BODY_LINES, LETTER_BODY_LINES = 50, 10

DOC = ["doc_id"]
PAGE = ["doc_id", "page"]


def page_lines(pages: DataFrame) -> DataFrame:
    """``(doc_id, page, text)`` to one row per line, numbered from 0; null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return pages.select("doc_id", "page", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def line_text(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "page", "line_no", strip(F.coalesce("line", F.lit(""))).alias("line"))


def line_kinds(lines: DataFrame) -> DataFrame:
    """Adds ``kind`` by the line alone (N, A, L or null) and ``stops``."""
    rows = line_text(lines)
    line = F.col("line")
    return rows.withColumns({
        "kind": F.when(line.rlike(NUMBERED), "N").when(line.rlike(APPENDIX), "A").when(line.rlike(LETTER), "L"),
        "stops": (line == "") | line.rlike(NUMBERED_STOP) | line.rlike(APPENDIX_STOP) | line.rlike(LETTER_STOP),
    })


def classify(lines: DataFrame) -> DataFrame:
    """As :func:`line_kinds`, but a letter counts only once the document has had a number or an appendix.

    That place is one row per document, from a partial aggregation, so no task sorts a whole document.
    """
    rows = line_kinds(lines)
    place = F.struct("page", "line_no")
    first = rows.where(F.col("kind").isin("N", "A")).groupBy(*DOC).agg(F.min(place).alias("first"))
    late = F.coalesce(place > F.col("first"), F.lit(False))
    return rows.join(first, DOC, "left").withColumn("kind", F.when((F.col("kind") != "L") | late, F.col("kind"))).select("doc_id", "page", "line_no", "line", "kind", "stops")


def carried_numbers(starts: DataFrame) -> DataFrame:
    """``(doc_id, page, carried)``: the last number or appendix of the document's earlier pages, by a window over pages, not lines."""
    own = F.when(F.col("own").isNotNull(), F.struct("line_no", "own"))
    pages = starts.groupBy(*PAGE).agg(F.max(own)["own"].alias("last"))
    before = W.partitionBy(*DOC).orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    return pages.select(*PAGE, F.last("last", ignorenulls=True).over(before).alias("carried"))


def segments(rows: DataFrame) -> DataFrame:
    """One row per start line with its body: the lines after it up to a stop, the limit or the page's end.

    rows has ``kind`` (null: no start) and ``stops``. Stops include starts, so no body line is ever a
    start, and running sums alone give the same segments as reading line by line.
    """
    order = W.partitionBy(*PAGE).orderBy("line_no")
    rows = rows.withColumns({"seg": F.sum(F.col("kind").isNotNull().cast("int")).over(order), "rn": F.row_number().over(order)}).where("seg > 0")
    own = W.partitionBy(*PAGE, "seg").orderBy("line_no")
    limit = F.when(F.first("kind").over(own).isin("L", "R"), LETTER_BODY_LINES).otherwise(BODY_LINES)
    is_body = F.col("kind").isNull() & (F.col("halted") == 0) & (F.col("dist") <= F.col("room"))
    rows = rows.withColumns({
        "halted": F.sum((F.col("stops") & F.col("kind").isNull()).cast("int")).over(own),
        "dist": F.col("rn") - F.first("rn").over(own), "room": limit,
    })
    start = F.col("kind").isNotNull()
    return (
        rows.where(start | is_body).groupBy(*PAGE, "seg")
        .agg(
            F.max(F.when(start, F.col("line_no"))).alias("line_no"), F.max(F.when(start, F.col("kind"))).alias("kind"),
            F.max(F.when(start, F.col("line"))).alias("line"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~start, F.struct("line_no", "line")))), lambda x: x["line"]), " ").alias("tail"),
        ).drop("seg")
    )


def clause_id(*parts: str) -> Column:
    return F.concat(F.lit("clause_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8))


def _own_number() -> Column:
    """The number of a line that is of kind N or A."""
    first = lambda p: F.regexp_extract("line", p, 1)
    return F.when(F.col("kind") == "N", first(NUMBERED)).when(F.col("kind") == "A", F.concat(F.lit("Appendix "), first(APPENDIX)))


def _numbers(c: DataFrame) -> DataFrame:
    first = lambda p: F.regexp_extract("line", p, 1)
    second = lambda p: F.regexp_extract("line", p, 2)
    appendix = F.col("kind") == "A"
    return c.withColumns({
        "own": _own_number(),
        "title": F.when(F.col("kind") == "N", strip(second(NUMBERED))).when(appendix, F.nullif(strip(second(APPENDIX)), F.lit(""))),
        "sign": F.when(F.col("kind") == "L", first(LETTER)), "lead": F.when(F.col("kind") == "L", second(LETTER)),
        "clause_id": clause_id("doc_id", "page", "line_no"),
    })


def _finish(c: DataFrame) -> DataFrame:
    """Flags, constant fields, links to the parent's id (the last clause of that number) and the full text."""
    by_number = c.groupBy("doc_id", F.col("clause_number").alias("parent_clause_number")).agg(
        F.max_by("clause_id", F.struct("page", "line_no")).alias("parent_clause_id")
    )
    head = F.concat(F.lit("["), F.col("clause_number"), F.lit("]"), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" "), F.col("title"))).otherwise(F.lit("")))
    return (
        c.join(by_number, ["doc_id", "parent_clause_number"], "left")
        .withColumns({
            "body_with_subitems": F.col("body_text"),
            "has_parent": F.col("parent_clause_number").isNotNull(),
            "has_body": strip("body_text") != "",
            "is_orphan_note": F.lit(False), "confidence": F.lit("high"),
            "notes": F.array().cast("array<struct<text:string,type:string>>"), "exceptions": F.array().cast("array<struct<text:string,type:string>>"),
            "page_start": F.col("page"), "page_end": F.col("page"),
            "full_normalized_text": F.concat(head, F.when(F.col("body_text") != "", F.concat(F.lit("\n"), F.col("body_text"))).otherwise(F.lit(""))),
        })
    )


def clauses(lines: DataFrame, dialect: str = "deployed") -> DataFrame:
    """Clauses of ``(doc_id, page, line_no, line)``, in the deployed or the strict dialect.

    Letters are segmented before it is known whether a number precedes them in the document: those
    that none precedes are dropped afterwards, which changes no other clause, as none is open there.
    So lines are dealt by page, and only a row per page meets the others of its document. Lines are
    read once: the start lines with their bodies are kept, and parents are found among them.
    """
    if dialect == "strict":
        return strict_clauses(lines)
    if dialect != "deployed":
        raise ValueError(f"unknown dialect {dialect!r}")
    starts = kept(_numbers(segments(line_kinds(lines))))
    c = starts.join(carried_numbers(starts), PAGE, "left")
    here = F.last("own", ignorenulls=True).over(W.partitionBy(*PAGE).orderBy("line_no"))
    c = c.withColumn("parent_own", F.coalesce(here, "carried")).where("kind != 'L' OR parent_own IS NOT NULL")
    return _finish(
        c.withColumns({
            "clause_number": F.when(F.col("kind") == "L", F.concat("parent_own", F.lit("("), "sign", F.lit(")"))).otherwise(F.col("own")),
            "parent_clause_number": F.when(F.col("kind") == "L", F.col("parent_own")).otherwise(last_part_dropped("own")),
            "level": (F.when(F.col("kind") == "L", dots("parent_own") + 2).otherwise(dots("own") + 1)).cast("int"),
            "body_text": F.when(F.col("kind") == "L", F.concat("lead", F.lit(" "), "tail")).otherwise(F.col("tail")),
        })
    ).drop("own", "parent_own", "carried", "sign", "lead", "tail", "line")


def remarks(texts: str | Column, kind: str = "NOTE") -> Column:
    """Notes or exceptions given as plain texts, as ``(text, type)``; null and empty ones go, and no list is an empty one."""
    own = F.filter(F.coalesce(col(texts), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.transform(own, lambda x: F.struct(x.alias("text"), F.lit(kind).alias("type")))


def with_remarks(found: DataFrame) -> DataFrame:
    """The clauses with notes and exceptions as ``(text, type)``, whether they come so or as plain texts, or not at all."""
    for name, kind in (("notes", "NOTE"), ("exceptions", "Exception")):
        if name not in found.columns:
            found = found.withColumn(name, F.array().cast("array<struct<text:string,type:string>>"))
        elif found.schema[name].dataType.elementType.typeName() != "struct":
            found = found.withColumn(name, remarks(name, kind))
    return found


def page_parents(rows: DataFrame) -> DataFrame:
    """Strict dialect: ``(doc_id, page, parent)``, the number that letters on a page hang on.

    It is that of the last N or L clause of earlier pages; a page that ends in an N resets it, one that
    ends in an L appends its letter. So it is a running group's number and the letters since.
    """
    place = lambda cond: F.max(F.when(cond, F.struct("line_no", "line")))
    pages = rows.groupBy(*PAGE).agg(place(F.col("n")).alias("last_n"), place(F.col("l")).alias("last_l"))
    doc = W.partitionBy(*DOC).orderBy("page")
    any_before = F.coalesce(F.max(F.col("last_n").isNotNull()).over(doc.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    resets = F.col("last_n").isNotNull() & (~any_before | F.col("last_l").isNull() | (F.col("last_n.line_no") > F.col("last_l.line_no")))
    pages = pages.withColumns({"resets": resets, "grows": ~resets & any_before & F.col("last_l").isNotNull()})
    pages = pages.withColumn("grp", F.sum(F.col("resets").cast("int")).over(doc))
    run = W.partitionBy(*DOC, "grp").orderBy("page")
    after = F.when(
        F.col("grp") > 0,
        F.concat(
            F.first(F.regexp_extract("last_n.line", NUMBERED, 1)).over(run),
            F.array_join(F.collect_list(F.when(F.col("grows"), F.concat(F.lit("("), F.regexp_extract("last_l.line", LETTER, 1), F.lit(")")))).over(run), ""),
        ),
    )
    return pages.withColumn("after", after).select(*PAGE, F.lag("after").over(doc).alias("parent"))


def strict_clauses(lines: DataFrame) -> DataFrame:
    """The strict dialect: roman sub-clauses, letters under the previous pages' last clause, one clause per number.

    Of clauses with the same number the last one's values stay, at the first one's place; map tasks
    send one clause per number, however often it is repeated. Lines are read twice, for what letters hang
    on (a row per page) and for the clauses.
    """
    rows = line_text(lines).withColumns({"n": F.col("line").rlike(NUMBERED), "l": F.col("line").rlike(LETTER), "r": F.col("line").rlike(ROMAN)})
    rows = rows.withColumn("a", F.col("line").rlike(APPENDIX))
    parents = kept(page_parents(rows))
    rows = rows.join(parents, PAGE, "left")
    kind = (
        F.when(F.col("n"), "N").when(F.col("a"), "A")
        .when(F.col("l"), F.when(F.col("parent").isNotNull(), "L"))
        .when(F.col("r") & F.contains(F.col("parent"), F.lit("(")), "R")
    )
    stops = (F.col("line") == "") | F.col("n") | F.col("a") | F.col("l") | F.col("r") | F.col("line").rlike(NOTE) | F.col("line").rlike(EXCEPTION)
    c = kept(_numbers(segments(rows.withColumns({"kind": kind, "stops": stops})))).join(parents, PAGE, "left")
    sub = F.col("kind").isin("L", "R")
    sign = F.when(F.col("kind") == "R", F.lower(F.regexp_extract("line", ROMAN, 1))).otherwise(F.col("sign"))
    lead = F.when(F.col("kind") == "R", F.regexp_extract("line", ROMAN, 2)).otherwise(F.col("lead"))
    base = F.substring_index("parent", "(", 1)
    c = c.withColumns({
        "clause_number": F.when(sub, F.concat("parent", F.lit("("), sign, F.lit(")"))).otherwise(F.col("own")),
        "parent_clause_number": F.when(sub, F.col("parent")).otherwise(last_part_dropped("own")),
        "level": F.when(F.col("kind") == "L", dots(base) + 2).when(F.col("kind") == "R", dots(base) + 3).otherwise(dots("own") + 1).cast("int"),
        "body_text": F.when(sub, F.concat(lead, F.lit(" "), F.col("tail"))).otherwise(F.col("tail")),
    }).drop("own", "parent", "sign", "lead", "tail", "line")
    place = F.struct("page", "line_no")
    values = F.struct(*(x for x in c.columns if x not in ("doc_id", "clause_number")))
    c = c.groupBy("doc_id", "clause_number").agg(F.max_by(values, place).alias("v"), F.min(place).alias("place")).select("doc_id", "clause_number", "v.*", "place")
    return _finish(c)


def document_title(found: DataFrame, default: str = "Technical Standard Document") -> DataFrame:
    """Per document the first level-1 title, else the first title, else the default."""
    place = F.struct("page", "line_no")
    titled = F.coalesce("title", F.lit("")) != ""
    return found.groupBy("doc_id").agg(
        F.coalesce(
            F.min_by(F.when(titled & (F.col("level") == 1), F.col("title")), F.when(titled & (F.col("level") == 1), place)),
            F.min_by(F.when(titled, F.col("title")), F.when(titled, place)), F.lit(default),
        ).alias("document_title")
    )
