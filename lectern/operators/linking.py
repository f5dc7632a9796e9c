"""Links from tables to clauses: by number prefix, by page, by neighbour page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import present


def number_index(clauses: DataFrame) -> DataFrame:
    """Per document and number the last clause."""
    return clauses.where(present("clause_number")).groupBy("doc_id", "clause_number").agg(F.max_by("clause_id", F.struct("page", "line_no")).alias("clause_id"))


def page_index(clauses: DataFrame) -> DataFrame:
    """Per document and page the deepest clause, the first of equals."""
    pages = clauses.where("page_start <= page_end").withColumn("on_page", F.explode(F.sequence("page_start", "page_end")))
    best = F.max_by(F.struct("clause_id", "clause_number"), F.struct("level", -F.col("page"), -F.col("line_no")))
    return pages.groupBy("doc_id", F.col("on_page").alias("page")).agg(best.alias("c"))


def _by_prefix(tables: DataFrame, clauses: DataFrame) -> DataFrame:
    """``(doc_id, table_id, clause_number, clause_id)`` for every dotted prefix of a table's number that is a clause's."""
    parts = F.split("table_number", r"\.")
    own = tables.where(present("table_number") & ~F.col("table_number").startswith("MODAL_P")).select(
        "doc_id", "table_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("clause_number")
    )
    return own.join(number_index(clauses), ["doc_id", "clause_number"])


def link_prefix(tables: DataFrame, clauses: DataFrame) -> DataFrame:
    """``(doc_id, table_id, clause_id, clause_number)`` by the longest dotted prefix of the table's number that is a clause's."""
    best = F.max_by(F.struct("clause_id", "clause_number"), F.length("clause_number"))
    return _by_prefix(tables, clauses).groupBy("doc_id", "table_id").agg(best.alias("c")).select("doc_id", "table_id", "c.*")


def link_page(tables: DataFrame, clauses: DataFrame, offset: int = 0) -> DataFrame:
    """Links by the page ``offset`` pages away."""
    own = tables.select("doc_id", "table_id", (F.col("page_start") + offset).alias("page"))
    return own.join(page_index(clauses), ["doc_id", "page"]).select("doc_id", "table_id", "c.*")


def link_neighbour(tables: DataFrame, clauses: DataFrame) -> DataFrame:
    """The page before, else the page after."""
    two = link_page(tables, clauses, -1).withColumn("k", F.lit(0)).unionByName(link_page(tables, clauses, 1).withColumn("k", F.lit(1)))
    return two.groupBy("doc_id", "table_id").agg(F.min_by(F.struct("clause_id", "clause_number"), "k").alias("c")).select("doc_id", "table_id", "c.*")


#: Ways of linking, in the order in which they are tried, and the page that each looks at.
WAYS = (("number", None), ("page", 0), ("neighbour", -1), ("neighbour", 1))


def link_cascade(tables: DataFrame, clauses: DataFrame) -> DataFrame:
    """Tables with ``parent_clause_id`` and ``parent_clause_number`` of the first way that finds one, and the way.

    All pages that a table may hang on are looked up in one join, and one aggregation takes the best.
    """
    key, clause = ["doc_id", "table_id"], F.struct("clause_id", "clause_number").alias("c")
    named = _by_prefix(tables, clauses).select(*key, F.struct(F.lit(0).alias("way"), (-F.length("clause_number")).alias("least")).alias("rank"), clause)
    places = F.array(*(F.struct(F.lit(k).alias("way"), (F.col("page_start") + offset).alias("page")) for k, (_, offset) in enumerate(WAYS) if offset is not None))
    near = tables.select(*key, F.explode(places).alias("p")).select(*key, "p.*").join(page_index(clauses), ["doc_id", "page"])
    near = near.select(*key, F.struct("way", F.lit(0).alias("least")).alias("rank"), F.col("c"))
    best = named.unionByName(near).groupBy(*key).agg(F.min_by(F.struct("c", "rank"), "rank").alias("b"))
    best = best.select(*key, F.col("b.c.clause_id").alias("parent_clause_id"), F.col("b.c.clause_number").alias("parent_clause_number"), F.array(*(F.lit(w) for w, _ in WAYS))[F.col("b.rank.way")].alias("link"))
    return tables.join(best, key, "left")


def link_stats(linked: DataFrame) -> DataFrame:
    """Linked and orphan tables per document; the share of no tables is 0."""
    n = F.count("*")
    return linked.groupBy("doc_id").agg(
        F.count("parent_clause_id").alias("linked"), (n - F.count("parent_clause_id")).alias("orphans"),
        F.coalesce(F.try_divide(F.count("parent_clause_id") * F.lit(100.0), n), F.lit(0.0)).alias("linked_percent"),
    )
