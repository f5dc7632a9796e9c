"""Operators against literals and a line-by-line reading of the clause grammar."""

import base64
import io
import json
import random
import re
import shutil
import zipfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.operators import chunks, geometry, linking, sinks, tables, validate
from lectern.operators import clauses as C
from lectern.plans import catalog
from lectern.functions import text as T
from lectern.plans.structuring import Readers, extract_complete, process, tables_only
from lectern.sources import detection, fakes, files, ocr

SF = "/root/testdata/sf0.001"


def parse(pages: dict[int, list[str]]):
    """A plain loop over lines: (number, title, parent, level, body)."""
    out, stack = [], None
    for page in sorted(pages):
        lines = [x.strip() for x in pages[page]]
        i = 0
        while i < len(lines):
            n = re.match(r"^(\d+(?:\.\d+)*)\s+([A-Z][^\n]+)$", lines[i])
            a = re.match(r"(?i)^APPENDIX\s+([A-Z](?:\.\d+)*)\s*[-–—:]*\s*([^\n]*)$", lines[i])
            l = re.match(r"^\(([a-z])\)\s+(.+)$", lines[i])
            if not (n or a or (l and stack)):
                i += 1
                continue
            body, j, room = [], i + 1, 50 if n or a else 10
            while j < len(lines) and j - i <= room and lines[j]:
                if re.match(r"^\d+(?:\.\d+)*\s+[A-Z]", lines[j]) or re.match(r"(?i)^APPENDIX\s+[A-Z]", lines[j]) or re.match(r"^\([a-z]\)\s+", lines[j]):
                    break
                body.append(lines[j])
                j += 1
            if n or a:
                own = n[1] if n else f"Appendix {a[1]}"
                stack = (own, own.count(".") + 1)
                out.append((own, (n or a)[2].strip() or None, own.rpartition(".")[0] or None, stack[1], " ".join(body)))
            else:
                out.append((f"{stack[0]}({l[1]})", None, stack[0], stack[1] + 1, l[2] + " " + " ".join(body)))
            i = j
    return out


TEMPLATES = ["{n}.{m} Title {n}", "{n} General", "(a) item", "(ii) roman", "APPENDIX B.{m} - Extra", "appendix to the end", "NOTE: x", "", "body {n}", "\tbody x ", "3 A", "more body"]


def rows(spark, pages, doc="d"):
    data = [(doc, p, i, t) for p, ls in pages.items() for i, t in enumerate(ls)]
    return spark.createDataFrame(data, "doc_id string, page int, line_no long, line string")


@pytest.mark.parametrize("seed", [1, 2])
def test_clauses_equal_a_line_loop(spark, seed):
    rng = random.Random(seed)
    pages = {p: [rng.choice(TEMPLATES).format(n=rng.randint(1, 9), m=rng.randint(1, 4)) for _ in range(150)] for p in (1, 2, 3)}
    pages[4] = ["1 Long", *["body"] * 70, "(b) letter", *["body"] * 15]
    got = C.clauses(rows(spark, pages)).orderBy("page", "line_no").select("clause_number", "title", "parent_clause_number", "level", "body_text").collect()
    assert [tuple(r) for r in got] == parse(pages)


@pytest.mark.parametrize("seed", [3, 4])
def test_letters_hang_on_the_last_number_of_earlier_pages(spark, seed):
    rng = random.Random(seed)
    docs = {}
    for d in ("d", "e", "f"):
        plain = ["(a) item", "(b) item", "body", "", "NOTE: x"]
        docs[d] = {p: [rng.choice(plain) for _ in range(rng.randint(1, 9))] for p in range(1, 13)}
        for p in rng.sample(range(2, 13), 3):  # numbers on three pages only, never on the first
            docs[d][p].insert(rng.randint(0, len(docs[d][p])), f"{p}.1 Title")
    frame = rows(spark, docs["d"]).union(rows(spark, docs["e"], "e")).union(rows(spark, docs["f"], "f"))
    got = C.clauses(frame).orderBy("doc_id", "page", "line_no").select("doc_id", "clause_number", "title", "parent_clause_number", "level", "body_text").collect()
    assert [tuple(r) for r in got] == [(d, *r) for d in docs for r in parse(docs[d])]
    kinds = {(r.doc_id, r.page, r.line_no) for r in C.classify(frame).where("kind IS NOT NULL").collect()}
    assert kinds == {(r.doc_id, r.page, r.line_no) for r in C.clauses(frame).collect()}


def test_letter_before_any_clause_and_defects(spark):
    pages = {1: ["(a) orphan", "1.1 Scope", "body", "", "lost", "(a) item", "1.1 Scope again"]}
    got = C.clauses(rows(spark, pages)).orderBy("line_no").collect()
    assert [(r.clause_number, r.body_text, r.has_parent) for r in got] == [("1.1", "body", True), ("1.1(a)", "item ", True), ("1.1", "", True)]
    assert got[1].parent_clause_id == got[2].clause_id  # the last of equal numbers
    assert got[1].full_normalized_text == "[1.1(a)]\nitem "


def test_strict_chains_letters_across_pages(spark):
    pages = {1: ["3.1 One", "(a) orphan on page one"], 2: ["(a) first", "(ii) not yet"], 3: ["(b) second", "(II) roman"]}
    got = {r.clause_number: r for r in C.clauses(rows(spark, pages), "strict").collect()}
    assert set(got) == {"3.1", "3.1(a)", "3.1(a)(b)", "3.1(a)(ii)"}
    assert got["3.1(a)(ii)"].level == 4 and got["3.1(a)(b)"].parent_clause_number == "3.1(a)"
    with pytest.raises(ValueError):
        C.clauses(rows(spark, pages), "other")


def test_chunk_plan(spark):
    want = {85: 1, 100: 1, 101: 2, 150: 2, 300: 4, 611: 7, 650: 7}
    got = chunks.chunk_plan(spark.createDataFrame([(n, n) for n in want], "doc_id long, total_pages int"))
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want
    last = got.where("doc_id = 650").orderBy(F.desc("chunk_index")).first()
    assert (last.page_start, last.page_end, last.page_count) == (559, 650, 92)


@pytest.mark.parametrize(
    ("caption", "number", "title"),
    [("Table 3.1 - Sizes", "3.1", "Sizes"), ("3.1 Installation", "3.1", "nstallation"), ("TABLE 4: abc", "4", None), ("Table 53.21 Bad", None, None), ("no number", None, None), ("Table 2.1 Cables (Continued) ", "2.1", "Cables ")],
)
def test_captions(spark, caption, number, title):
    got = spark.createDataFrame([(caption,)], "caption string").select(geometry.parse_caption().alias("p")).select("p.*").first()
    assert (got.table_number, got.title) == (number, title)


def test_filters_and_text(spark):
    data = [
        (1, None, 3, [["a", "b"]], [["1", "x"], ["2", "y"]], None), (2, None, 2, [["a"]], [["1"]], "narrow"), (3, "1", 3, [], [], "empty"), (4, "1", 3, [], [["", "same words"], ["", "other"]], "duplicate_columns"),
        (5, "1", 3, [], [["COPYRIGHT"]], "garbled"), (6, "1", 3, [], [["", "", "", "", "", "", "", "", "", "", "", " "]], "sparse"),
    ]
    raw = spark.createDataFrame(data, "pos int, table_number string, column_count int, header_rows array<array<string>>, data_rows array<array<string>>, want string")
    got = raw.select("want", tables.filter_reason().alias("got")).collect()
    assert [r.want for r in got] == [r.got for r in got]
    one = tables.convert(raw.where("pos = 1").withColumns({"doc_id": F.lit("d"), "page": F.lit(6), "title": F.lit(None).cast("string"), "confidence": F.lit(0.7)})).first()
    assert one.normalized_text_representation == "TABLE MODAL_P6_T1\nCOLUMNS: a | b\nROW 1: 1 | x\nROW 2: 2 | y"
    assert (one.table_id, one.confidence) == ("modal_6_1_MODAL_P6_T1", "medium")
    assert tables.quality_filter(tables.quality_filter(raw)).count() == tables.quality_filter(raw).count() == 1


CLAUSE_FIELDS = (
    "doc_id string, page int, line_no int, clause_id string, clause_number string, title string, parent_clause_id string, parent_clause_number string, "
    "body_with_subitems string, notes array<struct<type:string,text:string>>, page_start int, page_end int, has_parent boolean, has_body boolean, is_orphan_note boolean"
)


def clause_rows(spark, doc, specs):
    rows = []
    for i, (number, extra) in enumerate(specs):
        r = {"title": None, "pid": None, "parent": None, "body": "text", "notes": [], "page": 2, "has_parent": False} | extra
        rows.append((doc, r["page"], i, f"{doc}{i}", number, r["title"], r["pid"], r["parent"], r["body"], r["notes"], r["page"], r["page"], r["has_parent"], True, False))
    return spark.createDataFrame(rows, CLAUSE_FIELDS)


def test_every_clause_rule_finds_its_rows(spark):
    note = [("NOTE", "n")]
    docs = {
        "single": [("7", {"title": "ISO 9001"}), ("10", {}), ("1.1", {})],  # 2 of 3, one with a standard's title
        "edge": [*((str(i), {}) for i in range(1, 4)), *((f"{i}.1", {}) for i in range(1, 8))],  # 3 of 10 is not more than 0.3
        "toc": [("1.1", {"body": "a\nScope ..... 12\nb"}), ("1.2", {"body": "x ... y"})],
        "ones": [(f"1.{i}", {"page": 1}) for i in range(5)] + [("1.9", {})],  # 5 of 6 on page 1
        "flat": [(f"Appendix {chr(65 + i)}", {}) for i in range(11)],  # 11 without a dot
        "first": [("2.1", {}), ("1.1", {})],
        "parents": [("1.1", {"has_parent": True}), ("1.2", {"parent": "1.1"}), ("1.3", {"parent": "9", "has_parent": True}), ("1.4", {"parent": "1.1", "pid": "parents0", "has_parent": True})],
        "blank": [("1.1", {"body": " \n"}), ("1.2", {"body": "", "notes": note}), ("1.3", {"notes": note})],
        "twice": [("1.1", {}), ("1.1", {}), ("1.1", {})],
    }
    frame = None
    for doc, specs in docs.items():
        own = clause_rows(spark, doc, specs)
        frame = own if frame is None else frame.union(own)
    found = validate.clause_issues(frame).collect()
    got = sorted((r.doc_id, r.type, r.severity, r.clause_id) for r in found)
    want = [
        ("blank", "empty_body", "warning", "blank0"), ("blank", "empty_body", "warning", "blank1"), ("blank", "orphan_note", "warning", "blank1"),
        ("first", "unexpected_first_clause", "warning", None), ("flat", "poor_hierarchy", "warning", None),
        ("ones", "poor_page_tracking", "warning", None),
        ("parents", "inconsistent_parent", "error", "parents0"), ("parents", "inconsistent_parent", "error", "parents1"), ("parents", "missing_parent", "error", "parents2"),
        ("single", "header_as_clause", "error", "single0"), ("single", "single_digit_contamination", "error", None),
        ("single", "unexpected_first_clause", "warning", None),
        ("toc", "toc_contamination", "error", None), ("toc", "toc_in_body", "error", "toc0"), ("toc", "toc_in_body", "error", "toc1"),
        ("twice", "duplicate_number", "error", None),
    ]
    assert got == sorted(want, key=lambda r: (*r[:3], r[3] or ""))
    each = [r for rule in validate.CLAUSE_RULES.values() for r in rule(frame).collect()]
    assert sorted(each, key=repr) == sorted(found, key=repr)
    flags = {r.clause_id: (r.has_parent, r.has_body, r.is_orphan_note) for r in validate.apply_flags(frame).collect()}
    assert flags["parents2"] == (False, True, False) and flags["blank1"] == (False, False, True) and flags["parents3"] == (True, True, False)


def test_ocr_json(spark):
    j = '{"elements":[{"Text":" a ","Bounds":[1,2,4,8],"Page":1},{"Text":"  ","Page":2}]}'
    frame = spark.createDataFrame([("d", j)], "doc_id string, json string")
    r = ocr.ocr_elements(frame, page_offset=10).collect()
    assert [(x.page, x.text, x.x, x.width, x.height) for x in r] == [(12, "a", 1.0, 3.0, 6.0)]
    assert sorted(x.page for x in ocr.ocr_pages(frame).collect()) == [2, 3]


def test_chunks_are_read_side_by_side(spark):
    class OneBadChunk:
        def read(self, doc_id, page_start, page_end):
            if page_start == 94:
                raise ValueError("no pages")
            return '{"elements":[{"Text":"first","Page":0},{"Text":"last","Page":%d}]}' % (page_end - page_start)

    plan = chunks.chunk_plan(spark.createDataFrame([(1, 250), (2, 80)], "doc_id long, total_pages int"))
    read = ocr.read_chunks(plan, OneBadChunk())
    assert sorted((r.doc_id, r.chunk_index, r.success, r.error) for r in read.collect()) == [(1, 0, True, None), (1, 1, False, "no pages"), (1, 2, True, None), (2, 0, True, None)]
    found = ocr.chunk_elements(read).collect()
    assert sorted((r.doc_id, r.page, r.text) for r in found) == [(1, 1, "first"), (1, 93, "last"), (1, 187, "first"), (1, 250, "last"), (2, 1, "first"), (2, 80, "last")]
    costs = {r.doc_id: (r.num_chunks, r.successful_chunks, r.total_cost) for r in chunks.chunk_metrics(read).collect()}
    assert costs == {1: (3, 2, 0.112), 2: (1, 1, 0.056)}


def test_read_captions_and_remarks(spark):
    want = {"table 3.1 - Sizes": ("3.1", "Sizes"), "3.1 Installation": ("3.1", "nstallation"), "A4 – abc": ("A4", None), "plain": (None, None), "": (None, None)}
    got = spark.createDataFrame([(c,) for c in want], "caption string").select("caption", geometry.parse_read_caption().alias("p")).select("caption", "p.*").collect()
    assert {r.caption: (r.table_number, r.title) for r in got} == want
    notes = spark.createDataFrame([(["a", "", None, "b"],), ([],), (None,)], "n array<string>").select(C.remarks("n").alias("r")).collect()
    assert [[tuple(x) for x in r.r] for r in notes] == [[("a", "NOTE"), ("b", "NOTE")], [], []]


def test_whole_run_and_outputs(spark, tmp_path):
    out = process(catalog.lines(spark, SF), catalog.raw(spark, SF))
    s = out.summary.orderBy("doc_id").collect()
    assert sum(r.total_clauses for r in s) == out.clauses.count() == 718
    assert all(r.total_issues == r.errors + r.warnings for r in s)
    assert all(r.text.endswith("-" * 80 + "\n") or "CLAUSES" in r.text for r in out.text.collect())
    assert tables_only(catalog.raw(spark, SF)).summary.agg(F.sum("total_clauses")).first()[0] == 0
    sinks.write_outputs(out.titles, out.clauses, out.tables, catalog.CLAUSE_JSON, str(tmp_path / "o"))
    written = {r.doc_id: json.loads(r.value) for r in spark.read.json(str(tmp_path / "o/clauses")).collect()}
    assert sum(map(len, written.values())) == 718 and len(list((tmp_path / "o").rglob("part-*"))) <= 3 * 8
    assert out.rejected.count() == 0


def test_pdf_reader_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"1 One\fbody")
    (tmp_path / "b.pdf").write_bytes(b"\xff\xfe")
    (tmp_path / "c.PDF").write_bytes(b"no")
    body = spark.createDataFrame([("a", base64.b64encode(b"1 One").decode()), ("b", None)], "doc_id string, body string")
    sent = files.from_base64(body)
    assert [(r.doc_id, r.page, r.text) for r in files.read_pages(sent, files.PlainPages()).collect()] == [("a", 1, "1 One")] and sent.where("accepted").count() == 1
    got = files.read_pages(files.pdf_files(spark, str(tmp_path)), files.PlainPages()).collect()
    assert sorted((r.page, r.ok) for r in got) == [(0, False), (1, True), (2, True)]
    assert not files.pdf_files(spark, str(tmp_path), 5).where("accepted and content is null").count()


@pytest.mark.parametrize("own", ["a", " a\u00a0", "\x1ca\x1f", "\x1d\x1e", "\u2003a b\u3000", "\x85a", "", "a\x1cb  c"])
def test_strip_and_split_as_python_does(spark, own):
    got = spark.createDataFrame([(own,)], "t string").select(T.strip("t").alias("s"), T.words("t").alias("w")).first()
    assert (got.s, got.w) == (own.strip(), own.split())


def test_validators_read_unicode(spark):
    specs = [("7", {"title": "ISO\u00a09001"}), ("1.1", {"body": "Scope ..... 1\u0663"}), ("\u0661", {}), ("1.2", {"body": "line ..... x\u2028 5"})]
    got = {(r.type, r.clause_id) for r in validate.clause_issues(clause_rows(spark, "d", specs)).collect()}
    assert ("header_as_clause", "d0") in got and ("toc_contamination", None) in got and ("single_digit_contamination", None) in got


def test_table_json_has_every_field(spark):
    rows = lambda *r: [[*x] for x in r]
    raw = spark.createDataFrame(
        [(1, 6, 1, "3.2", None, 0.75, rows(["Type", "Normal"]), rows(["MIMS", "100"], ["PE", "70"]), 2, True)],
        "doc_id long, page int, pos int, table_number string, title string, confidence double, header_rows array<array<string>>, data_rows array<array<string>>, column_count int, has_merged_cells boolean",
    )
    one = tables.convert(raw)
    want = {
        "table_id": "modal_6_1_3_2", "table_number": "3.2", "title": None, "parent_clause_reference": None, "parent_clause_id": None, "parent_clause_number": None, "page_start": 6, "page_end": 6,
        "header_rows": [{"cells": ["Type", "Normal"], "is_header": True}], "data_rows": [{"cells": ["MIMS", "100"], "is_header": False}, {"cells": ["PE", "70"], "is_header": False}],
        "footer_notes": [], "raw_csv": None, "normalized_text_representation": "TABLE 3.2\nCOLUMNS: Type | Normal\nROW 1: MIMS | 100\nROW 2: PE | 70", "confidence": "medium",
        "source_method": "modal_table_transformer_structure", "extraction_notes": [], "table_key": None, "continuation_of": None, "quality_metrics": None, "has_headers": True, "is_multipage": False,
        "has_merged_cells": True,
    }
    got = json.loads(sinks.tables_json(one).first().json)
    assert got == [want] and [*got[0]] == [*want]  # in this order, reconstruction keys left out
    more = one.withColumns({"final_columns": F.array(F.lit("a")), "reconstruction_confidence": F.lit(None).cast("string"), "footer_notes": F.array(F.lit("see 1"), F.lit("see 2")), "quality_metrics": F.create_map(F.lit("fill"), F.lit("1.0"))})
    got = json.loads(sinks.tables_json(more).first().json)[0]
    assert got == want | {"final_columns": ["a"], "footer_notes": ["see 1", "see 2"], "quality_metrics": {"fill": "1.0"}} and len(tables.TABLE_FIELDS) == 28
    titles = spark.createDataFrame([(1, "T")], "doc_id long, document_title string")
    none = C.clauses(rows_of_nothing(spark))
    text = sinks.normalized_text(titles, none, more.withColumn("parent_clause_reference", F.lit("3"))).first().text
    assert "Number: 3.2\nParent Clause: 3\nPages: 6-6\n" in text and text.endswith("ROW 2: PE | 70\n\nFooter Notes:\n  * see 1\n  * see 2\n\n" + "-" * 80 + "\n")


def rows_of_nothing(spark):
    return spark.createDataFrame([], "doc_id long, page int, line_no long, line string")


def test_bad_table_rows_are_set_aside(spark):
    good = ("t1", 1, 1, "x", "high", [["a"]], [["b"]])
    data = [good, (None, *good[1:]), ("t2", None, *good[2:]), ("t3", 1, 1, None, *good[4:]), ("t4", 1, 1, "x", "sure", [["a"]], []), ("t5", 1, 1, "x", "low", [], [["b", None]])]
    frame = spark.createDataFrame(data, "table_id string, page_start int, page_end int, normalized_text_representation string, confidence string, header_rows array<array<string>>, data_rows array<array<string>>")
    fine, bad = tables.quarantine(frame)
    assert [r.table_id for r in fine.collect()] == ["t1"]
    assert {r.table_id: r.reason for r in bad.collect()} == {None: "table_id: missing", "t2": "page_start: missing", "t3": "normalized_text_representation: missing", "t4": "confidence: unknown", "t5": "data_rows: a cell is missing"}


def test_remarks_of_any_form(spark):
    plain = spark.createDataFrame([(1, ["a", ""])], "doc_id int, notes array<string>")
    formed = spark.createDataFrame([(1, [("t", "EXCEPTION")])], "doc_id int, exceptions array<struct<text:string,type:string>>")
    assert [tuple(x) for x in C.with_remarks(plain).first().notes] == [("a", "NOTE")] and C.with_remarks(plain).first().exceptions == []
    assert [tuple(x) for x in C.with_remarks(formed).first().exceptions] == [("t", "EXCEPTION")]


def test_answers_of_the_ocr_service(spark):
    body = json.dumps({"elements": [{"Text": "a", "Page": 0}]})
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("structuredData.json", body)
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("other.json", body)
    data = [
        ("text", body, None, None), ("zip", None, packed.getvalue(), None), ("none", None, None, None), ("broken", "{", None, None), ("list", "[1]", None, None), ("bad zip", None, b"PK", None),
        ("no entry", None, empty.getvalue(), None), ("limit", None, None, "DISQUALIFIED_SCAN_PAGE_LIMIT"), ("other", None, None, "timeout"),
    ]
    read = ocr.read_results(spark.createDataFrame(data, "doc_id string, body string, archive binary, error string"))
    got = {r.doc_id: (r.success, r.fallback_reason) for r in read.collect()}
    assert {d for d, (ok, _) in got.items() if ok} == {"text", "zip"} and got["text"][1] is None
    assert got["limit"] == (False, "adobe_api_limit") and {got[d] for d in ("none", "broken", "list", "bad zip", "no entry", "other")} == {(False, "adobe_error")}
    assert sorted(r.doc_id for r in ocr.ocr_elements(read.where("success")).collect()) == ["text", "zip"]


def test_documents_without_pages_are_not_digital(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 2000), ("b", 1, "x" * 100)], "doc_id string, page int, text string")
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    assert {r.doc_id: (r.is_digital, r.coverage) for r in geometry.pdf_type(pages, documents=docs).collect()} == {"a": (True, 100.0), "b": (False, 10.0), "c": (False, 0.0)}


def described(lines, tables, first=(), second=()):
    return "\n".join([*lines, json.dumps({"tables": tables, "first": list(first), "second": list(second)})])


def structured(score, x, y, cells=2):
    """A table of two rows (and a header) of 100 by 40 cells at (x, y)."""
    row = [["table row", [0, 40 * k, 100 * cells, 40 * k + 40], 0.9] for k in range(3)]
    column = [["table column", [100 * k, 0, 100 * k + 100, 120], 0.9] for k in range(cells)]
    return {"score": score, "box": [x, y, x + 100 * cells, y + 120], "elements": [*row, *column, ["table column header", [0, 0, 100 * cells, 30], 0.9], ["table row", [0, 500, 1, 501], 0.2]]}


def cell_texts(x, y, texts, cells=2):
    return [([x + 100 * c + 5, y + 40 * r + 5, x + 100 * c + 20, y + 40 * r + 20], texts[r][c]) for r in range(3) for c in range(cells) if texts[r][c]]


def test_from_files_to_outputs(spark, tmp_path):
    """Fakes for every model; a document of three pages, one whose text fails, one whose detector fails, one that can't be opened."""
    grid = [["key", "value"], ["one", "1"], ["two", ""]]
    page1 = described(
        ["1 General", "body", "1.1 Scope", "(a) item"], [structured(0.95, 50, 300), structured(0.7, 50, 600)],
        [([60, 250, 200, 260], "Table 1.1 - Read sizes"), *cell_texts(50, 300, grid)], [([155, 345, 160, 350], "12"), ([155, 385, 160, 390], "22")],
    )
    bare = {"score": 0.9, "box": [10, 100, 210, 200], "elements": []}
    page2 = described(["2 Second", "more"], [bare], [], [([20, 110, 30, 120], "a b c"), ([20, 130, 30, 140], "1 2 3"), ([20, 150, 30, 160], "4 5 6")])
    page3 = described(["3 Third"], [structured(0.85, 50, 300)], [([60, 250, 200, 260], "FAIL"), *cell_texts(50, 300, [["x", "y"], ["w1", "w2"], ["v1", "v2"]])], [([60, 250, 200, 260], "7 - Second reader"), ([55, 305, 60, 310], "xx"), ([155, 305, 160, 310], "yy")])
    docs = {"whole": "\f".join([page1, page2, page3]), "no text": described(["NO TEXT"], [structured(0.9, 50, 300)], [([60, 250, 200, 260], "Table 5 - Kept"), *cell_texts(50, 300, grid)]), "no model": "1 One\nNO MODEL"}
    for name, text in docs.items():
        (tmp_path / f"{name}.pdf").write_text(text)
    (tmp_path / "broken.pdf").write_bytes(b"\xff\xfe")

    class Pages(files.PlainPages):
        def pages(self, content):
            if b"NO TEXT" in content:
                raise ValueError("no text layer")
            return super().pages(content)

    class Service:
        def read(self, doc_id, page_start, page_end):
            return json.dumps({"elements": [{"Text": "seen", "Bounds": [60, 310, 80, 320], "Page": 0}]})

    def native(found):
        schema = "doc_id string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double"
        whole = next(r.doc_id for r in found.collect() if "whole" in r.doc_id)
        return spark.createDataFrame([(whole, 2, 1, "Table 4.4 - Far below", 10.0, 700.0, 90.0, 710.0)], schema)

    m = fakes.DescribedModels()
    models = detection.Models(fakes.PlainImages(), m, m, fakes.DescribedTexts("first"), fakes.DescribedTexts("second"))
    found = files.pdf_files(spark, str(tmp_path))
    for service in (None, Service()):
        out, status = extract_complete(found, Readers(Pages(), models, native, service))
        name = lambda d: d.rsplit("/", 1)[1].removesuffix(".pdf").replace("%20", " ")
        got = {name(r.doc_id): r for r in status.collect()}
        assert {d: (r.success, r.table_count, r.clause_count) for d, r in got.items()} == {"whole": (True, 3, 5), "no text": (True, 1, 0), "no model": (False, 0, 0), "broken": (False, 0, 0)}
        assert got["no text"].error == "Clauses extraction failed: no text layer" and got["no model"].error == "the model failed" and got["whole"].error is None
        assert got["whole"].cost_estimate == (0.05 if service else 0.0) and got["whole"].ocr_pages == (1 if service else 0)
        cells = lambda c: F.transform(c, lambda r: r["cells"]).alias(c)
        mine = {(name(r.doc_id), r.page): r for r in out.tables.select("doc_id", "page", "table_number", "title", "parent_clause_number", cells("header_rows"), cells("data_rows")).collect()}
        one, two, three = (mine["whole", p] for p in (1, 2, 3))
        assert (one.table_number, one.title, one.parent_clause_number) == ("1.1", "Read sizes", "1.1") and one.header_rows == [["key", "value"]] and one.data_rows == [["one", "12"], ["two", "22"]]
        assert (two.table_number, two.header_rows, two.data_rows, two.parent_clause_number) == ("MODAL_P2_T1", [["a", "b", "c"]], [["1", "2", "3"], ["4", "5", "6"]], "2")
        assert (three.table_number, three.title, three.header_rows, three.data_rows) == ("7", "Second reader", [["xx", "yy"]], [["w1", "w2"], ["v1", "v2"]])
        assert {name(r.doc_id) for r in out.text.collect()} == {"whole", "no text"} and out.rejected.count() == 0


def test_a_run_reads_the_lines_twice(spark):
    """Rows of the lines that a job summary reads: the clauses are computed once and kept."""
    lines, probe = catalog.lines(spark, SF), spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            probe.add(b.num_rows)
            yield b

    n = lines.count()
    frame = lines.mapInArrow(noted, lines.schema)
    out = process(frame, catalog.raw(spark, SF))
    assert out.summary.count() == 40
    assert probe.value <= 3 * n, probe.value / n


def test_empty_inputs(spark):
    none = rows(spark, {1: []})
    c = C.clauses(none)
    assert c.count() == 0 and C.clauses(none, "strict").count() == 0 and validate.clause_issues(c).count() == 0
    assert linking.page_index(c).count() == 0


def test_stream(spark, tmp_path):
    import json

    from lectern.streaming.documents import read_documents, structure_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"doc_id": "d", "pages": ["1 One\nbody", "(a) x"]}) + "\n")
    structure_stream(read_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r.clause_number for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"1", "1(a)"}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rounded(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["caption_run", "cell_run", "merge_totals", "gpu_cost", "v04_page_tracking", "v10_orphan_note", "filter_narrow", "clauses_strict", "clause_text", "issue_summary", "quality_filter", "link_cascade", "caption_parse", "region_text", "cell_grid", "merge_chunks", "normalized_text", "fallback_content", "ocr_elements", "clauses_json", "tables_json", "job_summary", "tables_only_summary", "read_caption_parse", "note_coercion", "table_overlay", "crop_bands", "ocr_pages"])
def test_queries_equal_their_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    result = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rounded(tuple(r) for r in frame.select(*(f"`{c}`" for c in columns)).collect()) == rounded(result.fetchall())


# --- many regions on one page --------------------------------------------------------------


def boxed(spark, n=60, boxes=3):
    """Regions of one page, of few different boxes; one id is there twice, one region has no document."""
    rng = random.Random(50)
    kinds = [(x, y, x + 150, y + 80) for x, y in ((rng.randrange(400), rng.randrange(600)) for _ in range(boxes))]
    regions = [(1, 1, i, *kinds[i % boxes]) for i in range(n)] + [(1, 1, 0, *kinds[1]), (None, 1, n, *kinds[0])]
    words = [(1, 1, k, rng.choice(["a", "bb", " ", "c c"]), rng.randrange(500), rng.randrange(700), 20, 12) for k in range(400)]
    names = "doc_id long, page int, region_id long, x0 long, y0 long, x1 long, y1 long"
    return regions, words, spark.createDataFrame(regions, names), spark.createDataFrame(words, "doc_id long, page int, seq long, text string, x long, y long, width long, height long")


def compared(monkeypatch, module, name="dealt_join", of=1):
    """How many rows the second frame given to a function has, call by call."""
    seen, own = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (seen.append(a[of].count()), own(*a, **k))[1])
    return seen


def spread(frame):
    return frame.select(F.spark_partition_id().alias("p")).distinct().count()


def as_lines(words):
    return words.selectExpr("doc_id", "page", "seq", "text", "x AS x0", "y AS y0", "x + width AS x1", "y + height AS y1")


def candidates_by_loop(regions, words):
    for d, p, t, x0, y0, x1, _ in regions:
        top, low = max(0, y0 - 200), y0 + 50
        for d2, p2, seq, text, x, y, w, h in words:
            inside = top <= y <= low or top <= y + h <= low or (y <= top and y + h >= low)
            if (d, p) == (d2, p2) and inside and x + w >= x0 - 100 and x <= x1 + 100 and text.strip():
                yield d, p, t, seq, text, y0 - (y + h)


def test_candidates_of_one_page_are_dealt(spark, monkeypatch):
    regions, words, r, w = boxed(spark)
    monkeypatch.setattr("lectern.functions.joins.PAIRS", 2000)
    got = geometry.caption_candidates(as_lines(w), r.withColumnRenamed("region_id", "table_id"))
    assert sorted(map(tuple, got.collect())) == sorted(candidates_by_loop(regions, words)) and spread(got) > 1


def top3_by_loop(regions, words):
    found = {}
    for d, p, t, seq, text, distance in candidates_by_loop(regions, words):
        found.setdefault((d, p, t), []).append((-distance, seq, text))
    return sorted((*k, " ".join(x[2] for x in sorted(v)[:3])) for k, v in found.items())


def test_captions_are_found_once_a_box(spark, monkeypatch):
    regions, words, r, w = boxed(spark)
    seen = compared(monkeypatch, geometry)
    got = geometry.captions(as_lines(w), r.withColumnRenamed("region_id", "table_id"))
    assert sorted(map(tuple, got.collect())) == top3_by_loop(regions, words) and max(seen) < 10


@pytest.mark.parametrize("name", ["caption_top3", "caption_parse"])
def test_caption_queries_compare_each_box_once(spark, monkeypatch, tmp_path, name):
    shutil.copy(f"{SF}/part.parquet", tmp_path)
    supplier = spark.read.parquet(f"{SF}/supplier.parquet")
    supplier.crossJoin(spark.range(10)).withColumn("s_suppkey", F.col("s_suppkey") + 1200 * F.col("id")).drop("id").write.parquet(str(tmp_path / "supplier.parquet"))
    seen = compared(monkeypatch, geometry)
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 100 and max(seen) == 10


def test_caption_run_compares_each_box_once(spark, monkeypatch):
    _, words, r, w = boxed(spark)
    found = r.where("doc_id IS NOT NULL").dropDuplicates(["region_id"]).selectExpr("doc_id", "page", "cast(region_id AS string) AS table_id", "x0", "y0", "x1", "y1")
    images = found.select("doc_id", "page").distinct().withColumn("image", F.lit(b"page"))
    seen, nothing = compared(monkeypatch, geometry), fakes.Ruled(lambda *box: None)
    assert detection.caption_run(found, images, as_lines(w), nothing, nothing).count() == 60 and max(seen) < 10


def texts_by_loop(regions, words, hit):
    found = {}
    for d, p, t, *box in regions:
        found.setdefault((d, p, t), []).extend((seq, text) for d2, p2, seq, text, *at in words if (d, p) == (d2, p2) and hit(*box, *at))
    return sorted(((*k, " ".join(x[1] for x in sorted(v))) for k, v in found.items()), key=repr)


def touches(x0, y0, x1, y1, x, y, w, h):
    return x <= x1 and x + w >= x0 and y <= y1 and y + h >= y0


@pytest.mark.parametrize("pairs", [100, 1 << 24])
def test_region_texts_are_made_once_a_box(spark, monkeypatch, pairs):
    regions, words, r, w = boxed(spark)
    monkeypatch.setattr("lectern.functions.joins.PAIRS", pairs)
    seen = compared(monkeypatch, geometry)
    got = geometry.region_text(w, r).collect()
    assert sorted(map(tuple, got), key=repr) == texts_by_loop(regions, words, touches) and max(seen) < 10


def test_overlay_makes_texts_once_a_box(spark, monkeypatch):
    regions, words, r, w = boxed(spark)
    t = r.withColumnRenamed("region_id", "table_id").unionByName(spark.createDataFrame([(1, 2, 99, 0, 0, 9, 9), (1, 1, None, 0, 0, 9, 9)], "doc_id long, page int, table_id long, x0 long, y0 long, x1 long, y1 long"))
    seen = compared(monkeypatch, geometry)
    got = sorted(((x.doc_id, x.page, x.table_id, x.adobe_text) for x in geometry.overlay(t, w, w).collect()), key=repr)
    text = {k[:3]: k[3] for k in texts_by_loop(regions, words, touches)}
    assert got == sorted([(*x[:3], None if x[0] is None else text[x[:3]]) for x in regions] + [(1, 2, 99, None), (1, 1, None, None)], key=repr) and max(seen) < 12


def test_cell_texts_are_made_once_a_box(spark, monkeypatch):
    regions, words, r, w = boxed(spark)
    seen = compared(monkeypatch, geometry)
    cells = r.withColumns({"row": F.lit(0), "column": F.lit(1)})
    got = geometry.cell_text(w, cells).select("doc_id", "page", "region_id", "text").collect()
    want = texts_by_loop(regions, words, lambda x0, y0, x1, y1, x, y, w, h: x0 <= x + w / 2 <= x1 and y0 <= y + h / 2 <= y1)
    assert sorted(map(tuple, got), key=repr) == [x for x in want if x[0]] and max(seen) < 10


def test_cells_of_one_table_are_dealt(spark, monkeypatch):
    """A table's cells are made by several tasks; one without an id has cells too."""
    monkeypatch.setattr("lectern.functions.joins.PAIRS", 100)
    e = [(t, f"table {kind}", [k * 5.0, k * 9.0, k * 5.0 + 8 + k % 5, k * 9.0 + 12], 0.9) for t in (None, 7) for kind in ("row", "column") for k in range(40)]
    shape = tables.structure(spark.createDataFrame(e, "table_id long, label string, bbox array<double>, confidence double")).withColumns({"width": F.lit(400), "height": F.lit(300)})
    grid = tables.cell_grid(shape)
    low = [min(300, r * 9 + 12) for r in range(40)]
    want = [(t, r, c, r < 1, c * 5, r * 9, c * 5 + 8 + c % 5, low[r], c % 5 >= 2 and low[r] - r * 9 >= 10) for t in (None, 7) for r in range(40) for c in range(40)]
    assert sorted(map(tuple, grid.collect()), key=repr) == sorted(want, key=repr) and spread(grid) > 1
