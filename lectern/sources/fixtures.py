"""Inputs derived from the driver's tables by integer arithmetic, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Expressions that Spark and other SQL engines read alike.
H = "((o_orderkey * 2654435761) % 1000003)"
K = "o_orderkey"
LINE = f"""CASE
    WHEN {H} % 20 IN (0, 1) THEN concat(1 + {H} % 9, '.', 1 + {K} % 4, ' Rules for ', o_orderpriority)
    WHEN {H} % 20 = 2 THEN concat(1 + {H} % 9, '.', 1 + {K} % 4, '.', 1 + {K} % 3, ' Detail ', o_orderstatus)
    WHEN {H} % 20 IN (3, 4, 5) THEN concat('(', substr('abcdef', cast(1 + {K} % 6 as int), 1), ') item ', o_orderpriority)
    WHEN {H} % 20 = 6 THEN '(ii) for underground use'
    WHEN {H} % 20 = 7 THEN concat('APPENDIX ', substr('ABC', cast(1 + {K} % 3 as int), 1), CASE WHEN {K} % 2 = 0 THEN '.1' ELSE '' END, ' - Extra ', o_orderstatus)
    WHEN {H} % 20 = 8 THEN concat('NOTE: see ', o_orderpriority)
    WHEN {H} % 20 = 9 THEN 'EXCEPTION: where exempt'
    WHEN {H} % 20 IN (10, 11) THEN ''
    WHEN {H} % 20 = 12 THEN '1.2 SCOPE ..... 33'
    WHEN {H} % 20 = 13 THEN concat(1 + {H} % 9, ' General')
    WHEN {H} % 20 = 14 THEN '3 A'
    WHEN {H} % 20 = 15 THEN '7 ISO 9001'
    ELSE concat('shall comply ', o_orderpriority, ' ', {K}) END"""
F1 = {"doc_id": "1 + o_custkey % 40", "page": "cast(1 + o_orderkey % 5 as int)", "line_no": K, "line": LINE}

C = "o_custkey"
NUMBER = f"""CASE WHEN {C} % 11 < 5 THEN NULL WHEN {C} % 11 = 5 THEN 'Z9.9' WHEN {C} % 12 = 11 THEN '1.1.1'
    ELSE concat(1 + {C} % 9, '.', 1 + {C} % 4, '.', 1 + {C} % 3) END"""
TITLE = f"CASE WHEN {C} % 12 = 9 THEN NULL WHEN {C} % 12 = 8 THEN 'Cables shall comply' ELSE concat('Table of ', {C}) END"
#: The cells of a data row, by the customer's remainder; arrays are written as array(...) or [...].
CELLS = [
    (2, "'', '', '', ''"), (3, "'COPYRIGHT', '', '', ''"), (4, "'●●●', '■■', '◆', ''"), (5, "{k}, {k}, {s}, 'z'"), (6, "{k}, 'daa', {p}, 'q'"),
]


def row_cells(c: str, k: str, s: str, p: str, array) -> str:
    f = lambda t: array(t.format(k=f"cast({k} as string)", s=s, p=p))
    whens = " ".join(f"WHEN {c} % 12 = {n} THEN {f(t)}" for n, t in CELLS)
    return f"""CASE {whens} WHEN {c} % 12 = 7 AND {k} % 2 = 0 THEN {f('{k}')} WHEN {c} % 12 = 7 THEN {f("{k}, {s}, {p}, 'r'")}
        ELSE {f('{k}, {s}, {p}, cast(' + k + ' % 3 as string)')} END"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clause_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in F1.items()))


def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    rows = orders.groupBy(C).agg(F.array_sort(F.collect_list(F.struct(F.col(K).alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")))).alias("os"))
    cells = row_cells(C, "o.k", "o.s", "o.p", lambda t: f"array({t})")
    return rows.selectExpr(
        f"1 + {C} % 40 AS doc_id", f"cast(1 + {C} % 7 as int) AS page", f"{C} AS pos", f"({C} % 100) / 100.0D AS confidence", f"{NUMBER} AS table_number", f"{TITLE} AS title",
        f"CASE WHEN {C} % 12 = 1 THEN 2 ELSE 4 END AS column_count",
        f"CASE WHEN {C} % 12 = 10 THEN cast(array() as array<array<string>>) ELSE array(array('key', 'status', 'priority', 'm')) END AS header_rows",
        f"CASE WHEN {C} % 12 = 0 THEN cast(array() as array<array<string>>) ELSE transform(os, o -> {cells}) END AS data_rows",
    )


F3_ELEMENTS = {
    "doc_id": "cast(1 as bigint)", "page": "cast(1 + p_partkey % 5 as int)", "seq": "p_partkey", "text": "p_name", "x": "p_partkey % 500", "y": "(p_partkey * 37) % 700",
    "width": "cast(10 + p_size as bigint)", "height": "cast(12 as bigint)",
}
F3_REGIONS = {
    "doc_id": "cast(1 as bigint)", "page": "cast(1 + s_suppkey % 5 as int)", "region_id": "s_suppkey", "x0": "s_suppkey * 7 % 400", "y0": "s_suppkey * 13 % 600",
    "x1": "s_suppkey * 7 % 400 + 150", "y1": "s_suppkey * 13 % 600 + 80",
}


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in F3_ELEMENTS.items()))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in F3_REGIONS.items()))


PAGE_COUNTS = (0, 1, 85, 93, 100, 101, 150, 300, 611, 650)


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame([(-1 - i, n) for i, n in enumerate(PAGE_COUNTS)], "doc_id long, total_pages int")
    return fixed.union(load(spark, sf_dir, "customer").selectExpr("c_custkey", "cast(1 + c_custkey % 700 as int)"))


#: Clauses that break the rules, by document: k and d as in the texts.
RULED = "(o_custkey % 16)"
RULE_CLAUSES = {
    "doc_id": "1000 + o_custkey % 16", "page": f"cast(CASE WHEN {RULED} % 8 = 2 THEN 1 ELSE 1 + o_orderkey % 5 END as int)", "line_no": K,
    "clause_id": f"concat('clause_', {K})",
    "clause_number": f"""CASE {RULED} % 8 WHEN 0 THEN concat(1 + {K} % 30) WHEN 3 THEN concat('Appendix ', substr('ABCDEFGH', cast(1 + {K} % 8 as int), 1)) ELSE concat(1 + {K} % 9, '.', 1 + {K} % 7) END""",
    "title": f"CASE {RULED} % 8 WHEN 0 THEN 'ISO 9001' WHEN 1 THEN 'Scope' END",
    "parent_clause_id": f"CASE WHEN {RULED} % 8 = 4 AND {K} % 3 = 0 THEN 'clause_x' END",
    "parent_clause_number": f"CASE WHEN {RULED} % 8 <> 4 THEN concat(1 + {K} % 9) WHEN {K} % 5 = 0 THEN '1' END",
    "body_text": f"""CASE WHEN {RULED} % 8 = 1 AND {K} % 3 = 0 THEN concat('Scope ..... ', {K}) WHEN {RULED} % 8 = 1 AND {K} % 3 = 1 THEN 'see ... below' WHEN {RULED} % 8 = 5 AND {K} % 2 = 0 THEN ' ' ELSE 'shall comply' END""",
    "has_parent": f"CASE WHEN {RULED} % 8 = 4 THEN {K} % 2 = 0 ELSE true END",
}
#: Whether a clause has a note.
NOTED = f"{RULED} % 8 = 5 AND {K} % 4 < 3"


def rule_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in RULE_CLAUSES.items()), f"CASE WHEN {NOTED} THEN array(named_struct('text', 'n', 'type', 'NOTE')) ELSE cast(array() as array<struct<text:string,type:string>>) END AS notes")
    return c.withColumns({"body_with_subitems": F.col("body_text"), "page_start": F.col("page"), "page_end": F.col("page"), "has_body": F.lit(True), "is_orphan_note": F.lit(False)})
