"""The queries' results as SQL text over the driver's tables."""

from __future__ import annotations

from ..operators import tables as T
from ..sources import fixtures as X

# Patterns, messages and the text template are those of the operators, spelt out once more.
N = r"^(\d+(?:\.\d+)*)\s+([A-Z][^\n]+)$"
A = r"(?i)^APPENDIX\s+([A-Z](?:\.\d+)*)\s*[-–—:]*\s*([^\n]*)$"
L = r"^\(([a-z])\)\s+(.+)$"
R = r"(?i)^\((i{1,3}|iv|v|vi{0,3}|ix|x)\)\s+(.+)$"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def dots(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '.', '')))"


def drop_last(x: str) -> str:
    return rf"CASE WHEN contains({x}, '.') THEN regexp_replace({x}, '\.[^.]*$', '') END"


def items(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


def _segments(kinds: str) -> str:
    return f"""
    sg AS (SELECT *, sum((kind IS NOT NULL)::int) OVER w AS seg, row_number() OVER w AS rn FROM {kinds} WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
    sh AS (SELECT *, sum((stops AND kind IS NULL)::int) OVER w AS halted, rn - first_value(rn) OVER w AS dist,
                  CASE WHEN first_value(kind) OVER w IN ('L', 'R') THEN 10 ELSE 50 END AS room
           FROM sg WHERE seg > 0 WINDOW w AS (PARTITION BY doc_id, page, seg ORDER BY line_no)),
    st AS (SELECT doc_id, page, max(line_no) FILTER (kind IS NOT NULL) AS line_no, max(kind) AS kind, max(line) FILTER (kind IS NOT NULL) AS line,
                  coalesce(string_agg(line, ' ' ORDER BY line_no) FILTER (kind IS NULL AND halted = 0 AND dist <= room), '') AS tail
           FROM sh GROUP BY doc_id, page, seg)"""


NUMBERS = f"""
    nb AS (SELECT *, CASE kind WHEN 'N' THEN regexp_extract(line, '{N}', 1) WHEN 'A' THEN 'Appendix ' || regexp_extract(line, '{A}', 1) END AS own,
                  CASE kind WHEN 'N' THEN {strip(f"regexp_extract(line, '{N}', 2)")} WHEN 'A' THEN nullif({strip(f"regexp_extract(line, '{A}', 2)")}, '') END AS title,
                  'clause_' || substr(sha256(concat_ws('|', doc_id, page, line_no)), 1, 8) AS clause_id FROM st)"""
FINISH = """
    lk AS (SELECT doc_id, clause_number AS parent_clause_number, arg_max(clause_id, page::BIGINT * 1000000000000 + line_no) AS parent_clause_id FROM c0 GROUP BY ALL),
    c AS (SELECT c0.*, lk.parent_clause_id, body_text AS body_with_subitems, parent_clause_number IS NOT NULL AS has_parent,
                 regexp_matches(body_text, '\\S') AS has_body, page AS page_start, page AS page_end, 'high' AS confidence, CAST([] AS VARCHAR[]) AS notes,
                 '[' || clause_number || ']' || CASE WHEN coalesce(title, '') <> '' THEN ' ' || title ELSE '' END
                 || CASE WHEN body_text <> '' THEN chr(10) || body_text ELSE '' END AS full_normalized_text
          FROM c0 LEFT JOIN lk USING (doc_id, parent_clause_number))"""
LINES = f"""
    f1 AS (SELECT {items(X.F1)} FROM orders),
    ln AS (SELECT doc_id, page, line_no, {strip("line")} AS line FROM f1)"""
CLASSIFIED = rf"""{LINES},
    kd AS (SELECT doc_id, page, line_no, line,
                  CASE WHEN regexp_matches(line, '{N}') THEN 'N' WHEN regexp_matches(line, '{A}') THEN 'A'
                       WHEN regexp_matches(line, '{L}') AND bool_or(regexp_matches(line, '{N}') OR regexp_matches(line, '{A}'))
                            OVER (PARTITION BY doc_id ORDER BY page, line_no) THEN 'L' END AS kind,
                  line = '' OR regexp_matches(line, '^\d+(?:\.\d+)*\s+[A-Z]') OR regexp_matches(line, '(?i)^APPENDIX\s+[A-Z]')
                  OR regexp_matches(line, '^\([a-z]\)\s+') AS stops
           FROM ln)"""
CLAUSES = f"""{CLASSIFIED}, {_segments("kd")}, {NUMBERS},
    np AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, line_no) AS up FROM nb),
    c0 AS (SELECT doc_id, page, line_no, kind, clause_id, title,
                  CASE WHEN kind = 'L' THEN up || '(' || regexp_extract(line, '{L}', 1) || ')' ELSE own END AS clause_number,
                  CASE WHEN kind = 'L' THEN up ELSE {drop_last("own")} END AS parent_clause_number,
                  (CASE WHEN kind = 'L' THEN {dots("up")} + 2 ELSE {dots("own")} + 1 END)::int AS level,
                  CASE WHEN kind = 'L' THEN regexp_extract(line, '{L}', 2) || ' ' || tail ELSE tail END AS body_text FROM np), {FINISH}"""

STRICT = rf"""{LINES},
    ck AS (SELECT *, regexp_matches(line, '{N}') AS n, regexp_matches(line, '{A}') AS a, regexp_matches(line, '{L}') AS l, regexp_matches(line, '{R}') AS r FROM ln),
    pg AS (SELECT doc_id, page, arg_max(line, line_no) FILTER (n) AS nl, max(line_no) FILTER (n) AS np, arg_max(line, line_no) FILTER (l) AS ll, max(line_no) FILTER (l) AS lp
           FROM ck GROUP BY doc_id, page),
    pf AS (SELECT *, coalesce(bool_or(nl IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM pg),
    pr AS (SELECT *, nl IS NOT NULL AND (NOT before OR lp IS NULL OR np > lp) AS resets FROM pf),
    pq AS (SELECT *, sum(resets::int) OVER (PARTITION BY doc_id ORDER BY page) AS grp FROM pr),
    pa AS (SELECT doc_id, page, CASE WHEN grp > 0 THEN first_value(regexp_extract(nl, '{N}', 1)) OVER w
                  || coalesce(string_agg(CASE WHEN NOT resets AND before AND lp IS NOT NULL THEN '(' || regexp_extract(ll, '{L}', 1) || ')' END, '') OVER w, '') END AS after
           FROM pq WINDOW w AS (PARTITION BY doc_id, grp ORDER BY page)),
    pp AS (SELECT doc_id, page, lag(after) OVER (PARTITION BY doc_id ORDER BY page) AS parent FROM pa),
    kd AS (SELECT ck.*, parent, CASE WHEN n THEN 'N' WHEN a THEN 'A' WHEN l THEN CASE WHEN parent IS NOT NULL THEN 'L' END WHEN r AND contains(parent, '(') THEN 'R' END AS kind,
                  line = '' OR n OR a OR l OR r OR regexp_matches(line, '^NOTES?:\s*.+') OR regexp_matches(line, '^EXCEPTIONS?:\s*.+') AS stops
           FROM ck JOIN pp USING (doc_id, page)), {_segments("kd")}, {NUMBERS},
    c1 AS (SELECT nb.doc_id, nb.page, line_no, kind, clause_id, title,
                  CASE kind WHEN 'L' THEN parent || '(' || regexp_extract(line, '{L}', 1) || ')' WHEN 'R' THEN parent || '(' || lower(regexp_extract(line, '{R}', 1)) || ')' ELSE own END AS clause_number,
                  CASE WHEN kind IN ('L', 'R') THEN parent ELSE {drop_last("own")} END AS parent_clause_number,
                  (CASE kind WHEN 'L' THEN {dots("split_part(parent, '(', 1)")} + 2 WHEN 'R' THEN {dots("split_part(parent, '(', 1)")} + 3 ELSE {dots("own")} + 1 END)::int AS level,
                  CASE kind WHEN 'L' THEN regexp_extract(line, '{L}', 2) || ' ' || tail WHEN 'R' THEN regexp_extract(line, '{R}', 2) || ' ' || tail ELSE tail END AS body_text
           FROM nb JOIN pp USING (doc_id, page)),
    c0 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY doc_id, clause_number ORDER BY page DESC, line_no DESC) = 1), {FINISH}"""

_ORDERED = "list({'k': o_orderkey, 's': o_orderstatus, 'p': o_orderpriority} ORDER BY o_orderkey)"
_CELLS = X.row_cells("o_custkey", "o.k", "o.s", "o.p", lambda t: f"[{t}]")
RAW = f"""
    os AS (SELECT o_custkey, {_ORDERED} AS os FROM orders GROUP BY o_custkey),
    raw AS (SELECT 1 + o_custkey % 40 AS doc_id, (1 + o_custkey % 7)::int AS page, o_custkey AS pos, (o_custkey % 100) / 100.0 AS confidence, {X.NUMBER} AS table_number, {X.TITLE} AS title,
                   CASE WHEN o_custkey % 12 = 1 THEN 2 ELSE 4 END AS column_count,
                   CASE WHEN o_custkey % 12 = 10 THEN CAST([] AS VARCHAR[][]) ELSE [['key', 'status', 'priority', 'm']] END AS header_rows,
                   CASE WHEN o_custkey % 12 = 0 THEN CAST([] AS VARCHAR[][]) ELSE list_transform(os, lambda o: {_CELLS}) END AS data_rows FROM os)"""
_W = lambda x: rf"list_filter(string_split_regex({strip(x)}, '\s+'), lambda y: y <> '')"
_LEFT, _RIGHT = "coalesce(r[i + 1], '')", "coalesce(r[i + 2], '')"
_MATCH = (
    f"(contains({_RIGHT}, {_LEFT}) OR contains({_LEFT}, {_RIGHT}) OR "
    f"len(list_intersect(list_distinct({_W(_LEFT)}), list_distinct({_W(_RIGHT)}))) > 0.7 * len({_W(_LEFT)}))"
)
MEASURED = f"""{RAW},
    ms AS (SELECT *, flatten(list_concat(header_rows, data_rows)) AS cells,
                  CASE WHEN len(data_rows) < 2 OR len(data_rows[1]) < 2 THEN CAST([] AS DOUBLE[])
                       ELSE list_transform(range(0, len(data_rows[1]) - 1), lambda i: len(list_filter(data_rows, lambda r: {_MATCH}))::DOUBLE / len(data_rows)) END AS sims FROM raw),
    mt AS (SELECT *, CASE WHEN len(cells) = 0 THEN 0.0 ELSE len(list_filter(cells, lambda x: {strip("x")} <> ''))::DOUBLE / len(cells) END AS density, array_to_string(cells, ' ') AS s FROM ms),
    mu AS (SELECT *, (contains(s, 'COPYRIGHT') AND length(s) < 100) OR length(s) - length(translate(s, '{T.SIGNS}', '')) > 0.3 * length(s)
                  OR contains(s, 'SWltchboat') OR contains(s, 'daa') OR contains(s, 'assreenener') AS garbled FROM mt),
    mv AS (SELECT *, CASE WHEN len(data_rows) = 0 THEN 'empty' WHEN column_count <= 2 AND (coalesce(table_number, '') = '' OR starts_with(table_number, 'MODAL_P')) THEN 'narrow'
                  WHEN density < 0.1 THEN 'sparse' WHEN garbled THEN 'garbled' WHEN len(list_filter(sims, lambda x: x > 0.85)) > 0 THEN 'duplicate_columns' END AS reason FROM mu)"""


def converted(source: str) -> str:
    return f"""
    t0 AS (SELECT * EXCLUDE (table_number), row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS idx, nullif(table_number, '') AS given FROM {source}),
    t1 AS (SELECT *, coalesce(given, 'MODAL_P' || page || '_T' || idx) AS table_number FROM t0),
    t AS (SELECT doc_id, page, pos, idx, table_number, title, header_rows, data_rows, page AS page_start, page AS page_end,
                 'modal_' || page || '_' || idx || '_' || replace(table_number, '.', '_') AS table_id,
                 CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS confidence, len(header_rows) > 0 AS has_headers,
                 array_to_string(list_concat(list_filter(['TABLE ' || table_number, 'TITLE: ' || nullif(title, ''),
                     CASE WHEN len(header_rows) > 0 THEN 'COLUMNS: ' || array_to_string(header_rows[1], ' | ') END], lambda x: x IS NOT NULL),
                     list_transform(data_rows, lambda r, i: 'ROW ' || i || ': ' || array_to_string(r, ' | '))), chr(10)) AS raw_text FROM t1),
    tt AS (SELECT *, {strip("raw_text")} AS normalized_text_representation FROM t)"""


ALL_TABLES = f"{RAW}, {converted('raw')}"
GOOD_TABLES = f"{MEASURED}, good AS (SELECT * FROM mv WHERE reason IS NULL), {converted('good')}"

_LINKS = """
    ni AS (SELECT doc_id, clause_number, arg_max(clause_id, page::BIGINT * 1000000000000 + line_no) AS clause_id FROM c GROUP BY ALL),
    px AS (SELECT doc_id, table_id, unnest(list_transform(range(1, len(string_split(table_number, '.')) + 1), lambda n: array_to_string(string_split(table_number, '.')[1:n], '.'))) AS clause_number
           FROM tt WHERE NOT starts_with(table_number, 'MODAL_P')),
    l1 AS (SELECT doc_id, table_id, arg_max(clause_id, length(clause_number)) AS clause_id, arg_max(clause_number, length(clause_number)) AS clause_number
           FROM px JOIN ni USING (doc_id, clause_number) GROUP BY ALL),
    pi AS (SELECT doc_id, page, clause_id, clause_number FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY level DESC, line_no) = 1),
    l2 AS (SELECT tt.doc_id, table_id, clause_id, clause_number FROM tt JOIN pi USING (doc_id, page)),
    l3 AS (SELECT tt.doc_id, table_id, clause_id, clause_number FROM tt JOIN pi ON tt.doc_id = pi.doc_id AND (pi.page = tt.page - 1 OR pi.page = tt.page + 1)
           QUALIFY row_number() OVER (PARTITION BY tt.doc_id, table_id ORDER BY pi.page) = 1),
    lt AS (SELECT tt.*, coalesce(l1.clause_id, l2.clause_id, l3.clause_id) AS parent_clause_id, coalesce(l1.clause_number, l2.clause_number, l3.clause_number) AS parent_clause_number,
                  CASE WHEN l1.clause_id IS NOT NULL THEN 'number' WHEN l2.clause_id IS NOT NULL THEN 'page' WHEN l3.clause_id IS NOT NULL THEN 'neighbour' END AS link
           FROM tt LEFT JOIN l1 USING (doc_id, table_id) LEFT JOIN l2 USING (doc_id, table_id) LEFT JOIN l3 USING (doc_id, table_id))"""
LINKED = f"{CLAUSES}, {ALL_TABLES}, {_LINKS}"
GOOD_LINKED = f"{CLAUSES}, {GOOD_TABLES}, {_LINKS}"

_COUNTS = r"""dc AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(clause_number, '^\d{1,2}$')) AS single,
    count(*) FILTER (regexp_matches(body_text, '(?m)\.{3,}.*\d+\s*$')) AS toc, count(*) FILTER (page_start = 1 AND page_end = 1) AS page_one,
    count(*) FILTER (contains(clause_number, '.')) AS dotted, arg_min(clause_number, page::BIGINT * 1000000000000 + line_no) AS first_number FROM c GROUP BY doc_id)"""
_ISSUE = "SELECT doc_id, '{0}' AS type, '{1}' AS severity, {2} AS clause_id, {3} AS message FROM {4}"
_NONE = "NULL::VARCHAR"
RULES = {
    "v01_single_digit": ("single_digit_contamination", "error", _NONE, "'Too many single-digit clause numbers (' || single || '/' || n || '). Likely parsing page numbers as clauses.'", "dc WHERE single / n > 0.3"),
    "v02_header_as_clause": ("header_as_clause", "error", "clause_id", "'Clause ' || clause_number || ' has standard title ''' || title || ''' - likely a header/footer'", r"c WHERE regexp_matches(clause_number, '^\d{1,2}$') AND regexp_matches(title, '(?i)^(AS/NZS|ISO|IEC|BS|EN)\s+\d+')"),
    "v03_toc_contamination": ("toc_contamination", "error", _NONE, "toc || ' clause(s) contain TOC-style dot leaders. Table of Contents not properly excluded.'", "dc WHERE toc > 0"),
    "v04_page_tracking": ("poor_page_tracking", "warning", _NONE, "page_one || '/' || n || ' clauses attributed to page 1. Page tracking may not be working correctly.'", "dc WHERE page_one / n > 0.7 AND n > 5"),
    "v05_inconsistent_parent": ("inconsistent_parent", "error", "clause_id", "'Clause ' || clause_number || CASE WHEN has_parent THEN ': has_parent=True but parent fields are null' ELSE ': has_parent=False but parent fields are set' END", "c WHERE has_parent <> (coalesce(parent_clause_id, '') <> '' OR coalesce(parent_clause_number, '') <> '')"),
    "v06_poor_hierarchy": ("poor_hierarchy", "warning", _NONE, "'Only ' || dotted || '/' || n || ' clauses have hierarchical numbering. Expected more X.X.X style clauses in a structured document.'", "dc WHERE dotted / n < 0.3 AND n > 10"),
    "v07_first_clause": ("unexpected_first_clause", "warning", _NONE, "'First clause is ''' || first_number || ''', expected ''1'' or ''1.1'''", r"dc WHERE NOT regexp_matches(first_number, '(?i)^(1|1\.1|Appendix)')"),
    "v08_empty_body": ("empty_body", "warning", "clause_id", "'Clause ' || clause_number || ' has empty body'", "c WHERE NOT has_body"),
    "v09_missing_parent": ("missing_parent", "error", "clause_id", "'Clause ' || clause_number || ' references non-existent parent ' || parent_clause_number", "c WHERE coalesce(parent_clause_number, '') <> '' AND NOT EXISTS (FROM c x WHERE x.doc_id = c.doc_id AND x.clause_number = c.parent_clause_number)"),
    "v10_orphan_note": ("orphan_note", "warning", "clause_id", "'Clause ' || clause_number || ' has notes but no body'", r"c WHERE len(notes) > 0 AND NOT regexp_matches(body_text, '\S')"),
    "v11_toc_in_body": ("toc_in_body", "error", "clause_id", "'Clause ' || clause_number || ' body contains TOC-style content (dot leaders)'", r"c WHERE regexp_matches(body_text, '\.{3,}')"),
    "v12_duplicate_number": ("duplicate_number", "error", _NONE, "'Duplicate clause number: ' || clause_number", "c GROUP BY doc_id, clause_number HAVING count(*) > 1"),
    "v13_missing_headers": ("missing_headers", "warning", _NONE, "'Table ' || coalesce(nullif(table_number, ''), table_id) || ' has no header rows'", "{t} WHERE len(header_rows) = 0"),
    "v14_empty_table": ("empty_table", "warning", _NONE, "'Table ' || coalesce(nullif(table_number, ''), table_id) || ' has no data rows'", "{t} WHERE len(data_rows) = 0"),
    "v15_suspicious_title": ("suspicious_table_title", "warning", _NONE, "'Table ' || coalesce(nullif(table_number, ''), table_id) || ' title may include clause prose: ' || CASE WHEN length(title) <= 100 THEN title ELSE substr(title, 1, 97) || '...' END", r"{t} WHERE coalesce(title, '') <> '' AND (length(trim(title)) > 100 OR regexp_matches(title, '(?i)\b(shall|must not|must)\b|\bin accordance with\b') OR regexp_matches(trim(title), '^\d+(\.\d+)+\s+\S+'))"),
    "v16_duplicate_table_number": ("duplicate_table_number", "warning", _NONE, "'Table number ' || table_number || ' appears ' || count(*) || ' times in output (check merge/dedup)'", "{t} WHERE coalesce(table_number, '') <> '' GROUP BY doc_id, table_number HAVING count(*) > 1"),
}


#: Rules that find nothing in the fixture of lines, so they are run over clauses made to break them.
ON_RULE_CLAUSES = ("v01_single_digit", "v03_toc_contamination", "v04_page_tracking", "v05_inconsistent_parent", "v06_poor_hierarchy", "v10_orphan_note", "v11_toc_in_body")
RULE_CLAUSES = f"c AS (SELECT *, page AS page_start, page AS page_end, CASE WHEN noted THEN ['n'] ELSE CAST([] AS VARCHAR[]) END AS notes FROM (SELECT {items(X.RULE_CLAUSES)}, {X.NOTED} AS noted FROM orders))"


def rule(name: str, tables: str = "tt") -> str:
    kind, severity, clause, message, source = RULES[name]
    return _ISSUE.format(kind, severity, clause, message, source.replace("{t}", tables))


_TITLED = "title IS NOT NULL AND title <> ''"
_PLACE = "page::BIGINT * 1000000000000 + line_no"
TITLES = f"ti AS (SELECT doc_id, coalesce(arg_min(title, {_PLACE}) FILTER ({_TITLED} AND level = 1), arg_min(title, {_PLACE}) FILTER ({_TITLED}), 'Technical Standard Document') AS document_title FROM c GROUP BY doc_id)"
_SEVERITIES = "count(*) AS total_issues, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info"
_ALL_ISSUES = " UNION ALL ".join(f"({rule(r)})" for r in RULES)
_TABLE_ISSUES = " UNION ALL ".join(f"({rule(r)})" for r in list(RULES)[12:])
_COLUMNS = "doc_id, page, line_no, kind, clause_id, clause_number"
_SUMMARY = "coalesce(total_issues, 0) AS total_issues, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(info, 0) AS info"


def as_json(fields: dict[str, str]) -> str:
    """A JSON object as text, its keys in the given order and its nulls kept."""
    return "to_json({" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "})::VARCHAR"


_CLAUSE_JSON = as_json({k: k for k in ("clause_id", "clause_number", "title", "parent_clause_id", "parent_clause_number", "level", "page_start", "page_end", "body_with_subitems")}
                       | {"notes": "CAST([] AS VARCHAR[])", "exceptions": "CAST([] AS VARCHAR[])"} | {"full_normalized_text": "full_normalized_text", "confidence": "confidence", "has_parent": "has_parent AND EXISTS (FROM c x WHERE x.doc_id = c.doc_id AND x.clause_number = c.parent_clause_number)", "has_body": "has_body"} | {"is_orphan_note": "false"})
_TABLE_JSON = as_json(
    {"table_id": "table_id", "table_number": "table_number", "title": "title", "parent_clause_reference": "NULL", "parent_clause_id": "parent_clause_id", "parent_clause_number": "parent_clause_number",
     "page_start": "page_start", "page_end": "page_end", "header_rows": "list_transform(header_rows, lambda r: {'cells': r, 'is_header': true})",
     "data_rows": "list_transform(data_rows, lambda r: {'cells': r, 'is_header': false})", "footer_notes": "CAST([] AS VARCHAR[])", "raw_csv": "NULL",
     "normalized_text_representation": "normalized_text_representation", "confidence": "confidence", "source_method": f"'{T.SOURCE_METHOD}'", "extraction_notes": "CAST([] AS VARCHAR[])",
     "table_key": "NULL", "continuation_of": "NULL", "quality_metrics": "NULL", "has_headers": "has_headers", "is_multipage": "false", "has_merged_cells": "false"}
)

_NL = "chr(10)"
_CBLOCK = (
    "'[CLAUSE]' || chr(10) || 'Number: ' || clause_number || chr(10) || CASE WHEN coalesce(title, '') <> '' THEN 'Title: ' || title || chr(10) ELSE '' END"
    " || CASE WHEN coalesce(parent_clause_number, '') <> '' THEN 'Parent: ' || parent_clause_number || chr(10) ELSE '' END || 'Level: ' || level || chr(10) || 'Pages: ' || page_start || '-' || page_end || chr(10)"
    " || 'Confidence: ' || confidence || chr(10) || chr(10) || 'Body:' || chr(10) || body_text || chr(10) || chr(10) || repeat('-', 80) || chr(10)"
)
_TBLOCK = (
    "'[TABLE]' || chr(10) || 'Number: ' || table_number || chr(10) || CASE WHEN coalesce(title, '') <> '' THEN 'Title: ' || title || chr(10) ELSE '' END || 'Pages: ' || page_start || '-' || page_end || chr(10)"
    " || 'Confidence: ' || confidence || chr(10) || chr(10) || normalized_text_representation || chr(10) || chr(10) || repeat('-', 80) || chr(10)"
)
NORMALIZED = f"""{CLAUSES}, {GOOD_TABLES}, {TITLES},
    cb AS (SELECT doc_id, string_agg({_CBLOCK}, chr(10) ORDER BY page, line_no) AS c FROM c GROUP BY doc_id),
    tb AS (SELECT doc_id, string_agg({_TBLOCK}, chr(10) ORDER BY page, pos) AS t FROM tt GROUP BY doc_id)
    SELECT doc_id, repeat('=', 80) || chr(10) || 'DOCUMENT TITLE: ' || document_title || chr(10) || repeat('=', 80) || chr(10) || chr(10) || 'CLAUSES' || chr(10) || repeat('=', 80) || chr(10)
           || coalesce(chr(10) || c, '') || coalesce(chr(10) || chr(10) || 'TABLES' || chr(10) || repeat('=', 80) || chr(10) || chr(10) || t, '') AS text
    FROM ti LEFT JOIN cb USING (doc_id) LEFT JOIN tb USING (doc_id)"""

CAPTION_TEXT = """CASE p_partkey % 8 WHEN 0 THEN concat('Table ', 1 + p_partkey % 90, '.', p_size, ' - ', p_name) WHEN 1 THEN concat('TABLE ', p_size, ': ', p_name, ' (continued)')
    WHEN 2 THEN concat(1 + p_partkey % 9, '.', p_size, ' - ', p_name) WHEN 3 THEN concat(1 + p_partkey % 9, '.', p_size, ' Installation') WHEN 4 THEN concat(p_size, ': ', p_name)
    WHEN 5 THEN concat('see table A', p_size, ' abc') WHEN 6 THEN concat('  ', p_name) ELSE '' END"""
CAPTION_LINES = {"doc_id": "cast(1 as bigint)", "page": "cast(1 + p_partkey % 5 as int)", "seq": "p_partkey", "text": CAPTION_TEXT, "x0": "p_partkey % 500", "y0": "(p_partkey * 37) % 700", "x1": "p_partkey % 500 + 10 + p_size", "y1": "(p_partkey * 37) % 700 + 12"}
_CAPS = f"cl AS (SELECT {items(CAPTION_LINES)} FROM part), rg AS (SELECT {items(X.F3_REGIONS)} FROM supplier), el AS (SELECT {items(X.F3_ELEMENTS)} FROM part)"
CANDIDATES = f"""{_CAPS}, ca AS (SELECT t.doc_id, t.page, t.region_id AS table_id, l.seq, l.text, t.y0 - l.y1 AS distance FROM cl l JOIN rg t ON l.doc_id = t.doc_id AND l.page = t.page
    AND (l.y0 BETWEEN greatest(0, t.y0 - 200) AND t.y0 + 50 OR l.y1 BETWEEN greatest(0, t.y0 - 200) AND t.y0 + 50 OR (l.y0 <= greatest(0, t.y0 - 200) AND l.y1 >= t.y0 + 50))
    AND l.x1 >= t.x0 - 100 AND l.x0 <= t.x1 + 100 WHERE {strip("l.text")} <> '')"""
TOP3 = f"{CANDIDATES}, tp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, table_id ORDER BY distance DESC, seq) AS rn FROM ca), cp AS (SELECT doc_id, page, table_id, string_agg(text, ' ' ORDER BY rn) AS caption FROM tp WHERE rn <= 3 GROUP BY ALL)"
_PATTERNS = [r"(?i)TABLE\s+([A-Z]?\d+\.\d+)", r"(?i)TABLE\s+([A-Z]?\d+)", r"^([A-Z]?\d+\.\d+)\s*[-–—:]", r"^([A-Z]?\d+\.\d+)\s+[A-Z]", r"^([A-Z]?\d+)\s*[-–—:]"]
_NUM = "CASE " + " ".join(f"WHEN regexp_matches(caption, '{p}') THEN regexp_extract(caption, '{p}', 1)" for p in _PATTERNS) + " END"
_REST = "CASE " + " ".join(f"WHEN regexp_matches(caption, '{p}') THEN regexp_extract(caption, '{p}([\\s\\S]*)$', 2)" for p in _PATTERNS) + " END"
_READ = [r"(?i)TABLE\s+([A-Z]?\d+\.?\d*)", r"(?i)^([A-Z]?\d+\.?\d*)\s*[-–—]", r"(?i)^([A-Z]?\d+\.?\d*)\s+\w"]
_READ_NUM = "CASE " + " ".join(f"WHEN regexp_matches(caption, '{p}') THEN regexp_extract(caption, '{p}', 1)" for p in _READ) + " END"
_READ_REST = "CASE " + " ".join(f"WHEN regexp_matches(caption, '{p}') THEN regexp_extract(caption, '{p}([\\s\\S]*)$', 2)" for p in _READ) + " END"
NOTES = "CASE WHEN p_size % 4 > 0 THEN array(p_brand, '', CASE WHEN p_size % 2 = 0 THEN p_type END) END"
OVERLAID = X.F3_REGIONS | {"page": "cast(1 + s_suppkey % 7 as int)"}
CELLS = "ce AS (SELECT doc_id, page, region_id, r AS row, k AS \"column\", x0 + 75 * k AS x0, y0 + 40 * r AS y0, x0 + 75 * k + 75 AS x1, y0 + 40 * r + 40 AS y1 FROM rg, (SELECT unnest([0, 1])::int AS r), (SELECT unnest([0, 1])::int AS k))"

SPANS = {"doc_id": "cast(1 as bigint)", "page": "cast(1 + p_partkey % 5 as int)", "block": "p_partkey % 40", "line": "p_partkey % 7", "seq": "p_partkey", "text": "CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_brand END", "x0": "p_partkey % 500", "size": "cast(p_size as double)", "font": "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END"}
IMAGE_SIZE = (480, 640)
ELEMENT = {"table_id": "p_partkey % 60", "label": "CASE WHEN p_size % 5 < 2 THEN 'table row' WHEN p_size % 5 < 4 THEN 'table column' ELSE 'table column header' END", "x0": "cast(p_partkey * 13 % 500 as double)", "y0": "cast(p_partkey * 37 % 700 as double)", "confidence": "cast(p_size as double) / 64"}
_EL = f"""e AS (SELECT {items(ELEMENT)} FROM part),
    rw AS (SELECT table_id, y0, row_number() OVER (PARTITION BY table_id ORDER BY y0) - 1 AS row, y0 - lag(y0) OVER (PARTITION BY table_id ORDER BY y0) AS gap FROM e WHERE label = 'table row'),
    co AS (SELECT table_id, x0, row_number() OVER (PARTITION BY table_id ORDER BY x0) - 1 AS col FROM e WHERE label = 'table column'),
    hd AS (SELECT table_id, max(y0 + 20) AS low FROM e WHERE label = 'table column header' GROUP BY ALL),
    ss AS (SELECT table_id, avg(confidence) AS confidence FROM e GROUP BY table_id),
    sr AS (SELECT table_id, count(*) AS n_rows, bool_or(coalesce(gap < 5, false)) AS merged FROM rw GROUP BY table_id),
    sa AS (SELECT table_id, count(*) AS above FROM rw JOIN hd USING (table_id) WHERE y0 < low GROUP BY table_id),
    sx AS (SELECT ss.table_id, confidence, coalesce(merged, false) AS has_merged_cells, coalesce(n_rows, 0) AS n_rows,
                  CASE WHEN low IS NOT NULL THEN greatest(1, least(3, coalesce(above, 0))) ELSE 1 END::int AS header_row_count
           FROM ss LEFT JOIN sr USING (table_id) LEFT JOIN hd USING (table_id) LEFT JOIN sa USING (table_id))"""
CASCADE = {"table_id": "p_partkey", "n": "CASE WHEN p_size % 3 = 0 THEN concat(p_size) END", "t": "CASE WHEN p_size % 3 <> 0 AND p_size % 5 = 0 THEN concat('T', p_size) END", "p": "CASE WHEN p_size % 3 <> 0 AND p_size % 5 <> 0 AND p_size % 7 = 0 THEN concat('P', p_size) END"}
_CASC = f"""k AS (SELECT {items(CASCADE)} FROM part), kc AS (SELECT table_id, CASE WHEN n IS NOT NULL THEN 'native' WHEN t IS NOT NULL THEN 'trocr' WHEN p IS NOT NULL THEN 'paddleocr' ELSE 'failed' END AS method,
    coalesce(n, t, p) AS table_number, CASE WHEN n IS NOT NULL THEN 'native title' WHEN t IS NOT NULL THEN 'trocr title' ELSE 'paddle title' END AS title FROM k)"""
COUNTS = f"pc AS (SELECT -1 - i AS doc_id, n AS total_pages FROM (SELECT unnest({list(X.PAGE_COUNTS)}) AS n, unnest(range({len(X.PAGE_COUNTS)})) AS i) UNION ALL SELECT c_custkey, (1 + c_custkey % 700)::int FROM customer)"
_NCH = "CASE WHEN total_pages > 100 THEN ceil(total_pages / 93.0)::int ELSE 1 END"
PLAN = f"""{COUNTS}, pl0 AS (SELECT *, unnest(range({_NCH}))::int AS chunk_index FROM pc),
    pl AS (SELECT doc_id, chunk_index, (CASE WHEN total_pages <= 100 THEN 1 ELSE chunk_index * 93 + 1 END)::int AS page_start,
        (CASE WHEN total_pages <= 100 THEN total_pages ELSE least(chunk_index * 93 + 93, total_pages) END)::int AS page_end, total_pages <= 100 AS is_original,
        (CASE WHEN total_pages <= 100 THEN total_pages ELSE least(chunk_index * 93 + 93, total_pages) - chunk_index * 93 END)::int AS page_count FROM pl0)"""

_c = lambda cols: f"WITH {CLAUSES} SELECT {cols} FROM c"
ORACLES = {
    "clause_lines": f"WITH {LINES} SELECT * FROM ln",
    "classify_lines": f"WITH {CLASSIFIED} SELECT doc_id, page, line_no, kind, stops FROM kd",
    "clause_fields": _c(f"{_COLUMNS}, title"),
    "clause_bodies": _c("doc_id, page, line_no, kind, body_text"),
    "clause_levels": _c("doc_id, page, line_no, clause_number, level"),
    "clause_parents": _c("doc_id, page, line_no, clause_number, parent_clause_number"),
    "letter_bodies": _c("doc_id, page, line_no, clause_number, body_text") + " WHERE kind = 'L'",
    "clause_flags": _c("doc_id, page, line_no, has_parent, has_body, false AS is_orphan_note, confidence"),
    "parent_links": _c("doc_id, clause_id, parent_clause_number, parent_clause_id"),
    "clause_text": _c("doc_id, clause_id, full_normalized_text"),
    "clauses_strict": f"WITH {STRICT} SELECT {_COLUMNS}, title, parent_clause_number, parent_clause_id, level, body_text, full_normalized_text FROM c",
    "clause_counts": f"WITH {CLAUSES} SELECT doc_id, kind, count(*) AS n FROM c GROUP BY ALL",
    **{r: f"WITH {RULE_CLAUSES if r in ON_RULE_CLAUSES else CLAUSES}, {_COUNTS} {rule(r)}" for r in list(RULES)[:12]},
    **{r: f"WITH {ALL_TABLES} {rule(r)}" for r in list(RULES)[12:]},
    "missing_parent_anti": _c("doc_id, clause_id, clause_number, parent_clause_number") + " WHERE coalesce(parent_clause_number, '') <> '' AND NOT EXISTS (FROM c x WHERE x.doc_id = c.doc_id AND x.clause_number = c.parent_clause_number)",
    "issue_summary": f"WITH {CLAUSES}, {_COUNTS}, {ALL_TABLES}, iss AS ({_ALL_ISSUES}) SELECT doc_id, {_SEVERITIES} FROM iss GROUP BY doc_id",
    "filter_empty": f"WITH {MEASURED} SELECT pos FROM mv WHERE len(data_rows) = 0",
    "filter_narrow": f"WITH {MEASURED} SELECT pos FROM mv WHERE len(data_rows) > 0 AND column_count <= 2 AND (coalesce(table_number, '') = '' OR starts_with(table_number, 'MODAL_P'))",
    "text_density": f"WITH {MEASURED} SELECT pos, round(density, 6) AS density FROM mv",
    "garbled": f"WITH {MEASURED} SELECT pos, garbled FROM mv",
    "column_similarity": f"WITH {MEASURED} SELECT pos, coalesce(round(list_max(sims), 6), -1.0) AS highest, len(sims)::int AS pairs FROM mv",
    "quality_filter": f"WITH {MEASURED} SELECT pos, reason FROM mv",
    "confidence_band": f"WITH {ALL_TABLES} SELECT pos, confidence FROM tt",
    "table_numbering": f"WITH {ALL_TABLES} SELECT pos, idx::int AS idx, table_number, table_id FROM tt",
    "table_text": f"WITH {ALL_TABLES} SELECT pos, normalized_text_representation FROM tt",
    "merged_cells": f"WITH {_EL} SELECT table_id, has_merged_cells, n_rows::int AS n_rows, round(confidence, 6) AS confidence FROM sx",
    "header_rows": f"WITH {_EL} SELECT table_id, header_row_count FROM sx",
    "cell_grid": f"""WITH {_EL} SELECT table_id, row::int AS row, col::int AS "column", is_header, x0, y0, x1, y1, x1 - x0 >= 10 AND y1 - y0 >= 10 AS readable FROM (
        SELECT *, row < header_row_count AS is_header, cx::int AS x0, ry::int AS y0, least({IMAGE_SIZE[0]}, cx + 30)::int AS x1, least({IMAGE_SIZE[1]}, ry + 20)::int AS y1
        FROM (SELECT table_id, row, y0 AS ry FROM rw) JOIN (SELECT table_id, col, x0 AS cx FROM co) USING (table_id) JOIN sx USING (table_id))""",
    "fallback_content": f"""WITH {LINES}, kept AS (SELECT doc_id * 10 + page AS table_id, line_no, string_split_regex(line, '\\s+') AS w FROM ln WHERE line <> ''),
        fb AS (SELECT table_id, list(w ORDER BY line_no) AS rows FROM kept GROUP BY table_id)
        SELECT table_id, array_to_string(rows[1], '|') AS header, len(rows)::int AS row_count, list_max(list_transform(rows, lambda r: len(r)))::int AS column_count,
               array_to_string(list_transform(rows[2:], lambda r: array_to_string(r, '|')), ';') AS data FROM fb""",
    "caption_cascade": f"WITH {_CASC} SELECT * FROM kc",
    "caption_stats": f"WITH {_CASC} SELECT method, count(*) AS n FROM kc GROUP BY method",
    "hybrid_cell_text": "SELECT p_partkey, CASE WHEN length(substr(p_brand, 1, p_size % 4)) < 2 AND p_size % 3 <> 0 THEN p_name ELSE substr(p_brand, 1, p_size % 4) END AS text FROM part",
    "link_prefix": f"WITH {LINKED} SELECT * FROM l1",
    "link_page": f"WITH {LINKED} SELECT * FROM l2",
    "link_neighbour": f"WITH {LINKED} SELECT * FROM l3",
    "link_cascade": f"WITH {LINKED} SELECT doc_id, table_id, parent_clause_id, parent_clause_number, link FROM lt",
    "link_stats": f"WITH {LINKED} SELECT doc_id, count(parent_clause_id) AS linked, count(*) - count(parent_clause_id) AS orphans, round(100.0 * count(parent_clause_id) / count(*), 6) AS linked_percent FROM lt GROUP BY doc_id",
    "caption_candidates": f"WITH {CANDIDATES} SELECT * FROM ca",
    "caption_top3": f"WITH {TOP3} SELECT * FROM cp",
    "caption_parse": rf"""WITH {TOP3}, r0 AS (SELECT *, {_NUM} AS num, {_REST} AS rest FROM cp),
        r1 AS (SELECT *, regexp_replace(regexp_replace({strip("rest")}, '^[-–—:\s]+', ''), '(?i)\(continued\)\s*$', '') AS ti,
                  coalesce(regexp_matches(num, '^\d{{2,}}\.\d{{2,}}$') AND TRY_CAST(split_part(num, '.', 1) AS BIGINT) > 50, false) AS garbage FROM r0)
        SELECT doc_id, page, table_id, CASE WHEN NOT garbage THEN num END AS table_number, CASE WHEN NOT garbage AND length(ti) > 3 THEN ti END AS title FROM r1""",
    "read_caption_parse": rf"""WITH r0 AS (SELECT p_partkey, {CAPTION_TEXT} AS caption FROM part), r1 AS (SELECT p_partkey, {_READ_NUM} AS table_number, regexp_replace({strip(f"({_READ_REST})")}, '^[-–—:\s]+', '') AS ti FROM r0)
        SELECT p_partkey, table_number, CASE WHEN length(ti) > 3 THEN ti END AS title FROM r1""",
    "note_coercion": """SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN 'NOTE: ' || p_brand || CASE WHEN p_size % 2 = 0 THEN '|NOTE: ' || p_type ELSE '' END ELSE '' END AS notes,
        CASE WHEN p_size > 25 THEN 'Exception: ' || p_name ELSE '' END AS exceptions FROM part""",
    "table_overlay": f"""WITH {_CAPS}, tv AS (SELECT {items(OVERLAID)} FROM supplier), pg AS (SELECT DISTINCT doc_id, page FROM el)
        SELECT t.doc_id, t.page, t.region_id AS table_id, CASE WHEN pg.page IS NOT NULL THEN coalesce(string_agg(e.text, ' ' ORDER BY e.seq), '') END AS adobe_text, CASE WHEN pg.page IS NOT NULL THEN 'adobe' END AS ocr_source,
               pg.page IS NOT NULL AND (t.region_id % 3 = 0 OR t.region_id % 4 = 0) AS adobe_ocr
        FROM tv t LEFT JOIN pg ON pg.doc_id = t.doc_id AND pg.page = t.page
        LEFT JOIN el e ON e.doc_id = t.doc_id AND e.page = t.page AND e.x <= t.x1 AND e.x + e.width >= t.x0 AND e.y <= t.y1 AND e.y + e.height >= t.y0 GROUP BY t.doc_id, t.page, t.region_id, pg.page""",
    "crop_bands": f"WITH {_CAPS} SELECT region_id, greatest(0, y0 - 100) AS top, y0 AS bottom FROM rg",
    "ocr_pages": """SELECT doc_id, page, 612 AS width, 792 AS height, sum(n)::int AS n_elements FROM (SELECT p_partkey AS doc_id, 1 + p_size AS page, 1 AS n FROM part
        UNION ALL SELECT p_partkey, 4, 0 FROM part UNION ALL SELECT p_partkey, 1, 1 FROM part) GROUP BY doc_id, page""",
    "region_text": f"WITH {_CAPS} SELECT r.doc_id, r.page, r.region_id, coalesce(string_agg(e.text, ' ' ORDER BY e.seq), '') AS text FROM rg r LEFT JOIN el e ON e.doc_id = r.doc_id AND e.page = r.page AND e.x <= r.x1 AND e.x + e.width >= r.x0 AND e.y <= r.y1 AND e.y + e.height >= r.y0 GROUP BY ALL",
    "cell_text": f"WITH {_CAPS}, {CELLS} SELECT c.doc_id, c.page, c.region_id, c.row, c.\"column\", string_agg(e.text, ' ' ORDER BY e.seq) AS text FROM ce c JOIN el e ON e.doc_id = c.doc_id AND e.page = c.page AND e.x + e.width / 2 BETWEEN c.x0 AND c.x1 AND e.y + e.height / 2 BETWEEN c.y0 AND c.y1 GROUP BY ALL",
    "native_lines": f"WITH s AS (SELECT {items(SPANS)} FROM part) SELECT doc_id, page, block, line, string_agg(text, '' ORDER BY seq) AS text, arg_min(x0, seq) AS x0, max(size) AS font_size, coalesce(arg_min(font, seq) FILTER (font <> ''), '') AS font_name FROM s GROUP BY doc_id, page, block, line HAVING trim(string_agg(text, '' ORDER BY seq)) <> ''",
    "pdf_type": f"SELECT doc_id % 50 AS doc_id, sum(length({strip('text')})) / count(*) > 100 AS is_digital, least(100.0, sum(length({strip('text')})) / count(*) / 10) AS coverage FROM documents WHERE 1 + doc_id // 50 <= 10 GROUP BY ALL",
    "ocr_elements": """SELECT p_partkey AS doc_id, 1 + p_size AS page, 0 AS seq, p_brand AS text, p_size::DOUBLE AS x, 2.5::DOUBLE AS y, 10::DOUBLE AS width, 12.5::DOUBLE AS height, 'Arial' AS font, 9.5::DOUBLE AS font_size FROM part
        UNION ALL SELECT p_partkey, 1, 2, 'no box', 0.0, 0.0, 0.0, 0.0, '', 0.0 FROM part""",
    "chunk_plan": f"WITH {PLAN} SELECT * FROM pl",
    "split_info": f"WITH {COUNTS} SELECT doc_id, total_pages, total_pages > 100 AS needs_splitting, {_NCH} AS num_chunks, 93 AS chunk_size, round({_NCH} * 0.056::DOUBLE, 3) AS estimated_cost, {_NCH} * 12.0::DOUBLE AS estimated_time FROM pc",
    "chunk_metrics": f"""WITH {PLAN} SELECT doc_id, count(*) AS num_chunks, count(*) FILTER (chunk_index % 5 <> 3) AS successful_chunks, count(*) FILTER (chunk_index % 5 <> 3) > 0 AS success,
        round(count(*) FILTER (chunk_index % 5 <> 3) * 0.056::DOUBLE, 3) AS total_cost, coalesce(sum(chunk_index * 1.5::DOUBLE + 11) FILTER (chunk_index % 5 <> 3), 0) AS processing_time FROM pl GROUP BY doc_id""",
    "merge_chunks": f"WITH {PLAN} SELECT doc_id, chunk_index, (page_start - 1 + 1 + abs(doc_id) % 3)::int AS page FROM pl",
    "merge_totals": f"""WITH {PLAN} SELECT doc_id, sum(chunk_index % 3)::BIGINT AS table_count, sum(chunk_index % 7 + 1)::BIGINT AS clause_count, round(sum(chunk_index * 1.5::DOUBLE + 11), 2) AS processing_time,
        round(count(*) * 0.056::DOUBLE, 3) AS cost_estimate, count(*) AS num_chunks FROM pl GROUP BY doc_id""",
    "gpu_cost": "SELECT p_partkey, round(p_size * 61::DOUBLE / 3600 * 0.43::DOUBLE, 4) AS cost FROM part",
    "caption_run": rf"""WITH {TOP3.replace("FROM cl l", "FROM (FROM cl WHERE page = 1) l")}, r0 AS (SELECT *, {_NUM} AS num, {_REST} AS rest FROM cp),
        r1 AS (SELECT table_id, num, regexp_replace(regexp_replace({strip("rest")}, '^[-–—:\s]+', ''), '(?i)\(continued\)\s*$', '') AS ti,
                  coalesce(regexp_matches(num, '^\d{{2,}}\.\d{{2,}}$') AND TRY_CAST(split_part(num, '.', 1) AS BIGINT) > 50, false) AS garbage FROM r0),
        tried AS (SELECT region_id::VARCHAR AS table_id, x0, y0, CASE WHEN NOT garbage THEN num END AS a, CASE WHEN NOT garbage AND length(ti) > 3 THEN ti END AS heading,
                  CASE WHEN x0 % 7 <> 0 AND x0 % 3 = 0 THEN x0 || '.' || y0 % 10 END AS b, CASE WHEN y0 % 5 <> 0 AND x0 % 2 = 0 THEN x0::VARCHAR END AS c
                  FROM rg LEFT JOIN r1 ON r1.table_id = rg.region_id)
        SELECT table_id, CASE WHEN a IS NOT NULL THEN 'native' WHEN b IS NOT NULL THEN 'trocr' WHEN c IS NOT NULL THEN 'paddleocr' ELSE 'failed' END AS method, coalesce(a, b, c) AS table_number,
               CASE WHEN a IS NOT NULL THEN heading WHEN b IS NOT NULL THEN 'wide' WHEN c IS NOT NULL THEN 'second' END AS title,
               CASE WHEN a IS NOT NULL THEN 'native_text' WHEN b IS NOT NULL THEN 'trocr' WHEN c IS NULL AND y0 % 5 = 0 THEN 'paddleocr_failed' ELSE 'paddleocr' END AS attempt FROM tried""",
    "cell_run": f"""WITH {_CAPS}, {CELLS}, rd AS (SELECT *, CASE WHEN x0 % 11 <> 0 AND x0 % 7 <> 0 THEN CASE WHEN x0 % 3 = 0 THEN 'a' || x0 ELSE 'b' END ELSE '' END AS a FROM ce)
        SELECT region_id::VARCHAR AS table_id, row, "column", row = 0 AS is_header, CASE WHEN length(a) >= 2 THEN a WHEN y0 % 5 = 0 THEN '' WHEN y0 % 2 = 0 THEN 'c' || y0 ELSE a END AS text FROM rd""",
    "document_title": f"WITH {CLAUSES}, {TITLES} SELECT * FROM ti",
    "normalized_text": f"WITH {NORMALIZED}",
    "clauses_json": f"WITH {CLAUSES}, cj AS (SELECT doc_id, page, line_no, {_CLAUSE_JSON} AS j FROM c) SELECT doc_id, '[' || string_agg(j, ',' ORDER BY page, line_no) || ']' AS json FROM cj GROUP BY doc_id",
    "tables_json": f"WITH {GOOD_LINKED} SELECT doc_id, '[' || string_agg({_TABLE_JSON}, ',' ORDER BY page, pos) || ']' AS json FROM lt GROUP BY doc_id",
    "job_summary": f"""WITH {CLAUSES}, {_COUNTS}, {GOOD_TABLES}, {TITLES}, iss AS ({_ALL_ISSUES}), iq AS (SELECT doc_id, {_SEVERITIES} FROM iss GROUP BY doc_id),
        ds AS (SELECT doc_id FROM ln UNION SELECT doc_id FROM raw), nc AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id), nt AS (SELECT doc_id, count(*) AS n FROM tt GROUP BY doc_id)
        SELECT doc_id, coalesce(document_title, 'Technical Standard Document') AS document_title, coalesce(nc.n, 0) AS total_clauses, coalesce(nt.n, 0) AS total_tables, {_SUMMARY}
        FROM ds LEFT JOIN ti USING (doc_id) LEFT JOIN nc USING (doc_id) LEFT JOIN nt USING (doc_id) LEFT JOIN iq USING (doc_id)""",
    "tables_only_summary": f"""WITH {GOOD_TABLES}, iss AS ({_TABLE_ISSUES}), iq AS (SELECT doc_id, {_SEVERITIES} FROM iss GROUP BY doc_id),
        ds AS (SELECT DISTINCT doc_id FROM raw), nt AS (SELECT doc_id, count(*) AS n FROM tt GROUP BY doc_id)
        SELECT doc_id, NULL::VARCHAR AS document_title, 0::BIGINT AS total_clauses, coalesce(nt.n, 0) AS total_tables, {_SUMMARY}
        FROM ds LEFT JOIN nt USING (doc_id) LEFT JOIN iq USING (doc_id)""",
    "page_line_stats": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, max(length({strip('line')})) AS longest FROM l WHERE {strip('line')} <> '' GROUP BY doc_id",
}
