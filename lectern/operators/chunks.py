"""Page chunks: plan, estimates, metrics and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_SIZE, MAX_PAGES = 93, 100
COST_PER_CHUNK, SECONDS_PER_CHUNK = 0.056, 12.0
GPU_DOLLARS_PER_HOUR = 0.43


def _size(chunk_size: int) -> int:
    return CHUNK_SIZE if chunk_size > MAX_PAGES else chunk_size


def _count(chunk_size: int):
    n = F.col("total_pages")
    return F.when(n > MAX_PAGES, F.ceil(n / F.lit(_size(chunk_size)))).otherwise(1).cast("int")


def chunk_plan(documents: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """``(doc_id, total_pages)`` to a row per chunk; up to 100 pages are one chunk, the original."""
    size = _size(chunk_size)
    idx = F.col("chunk_index")
    whole = F.col("total_pages") <= MAX_PAGES
    return (
        documents.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), _count(chunk_size) - 1)))
        .withColumns({
            "page_start": F.when(whole, 1).otherwise(idx * size + 1).cast("int"),
            "page_end": F.when(whole, F.col("total_pages")).otherwise(F.least(idx * size + size, F.col("total_pages"))).cast("int"),
            "is_original": whole,
        })
        .withColumn("page_count", F.when(whole, F.col("total_pages")).otherwise(F.col("page_end") - F.col("page_start") + 1).cast("int"))
        .select("doc_id", "chunk_index", "page_start", "page_end", "page_count", "is_original")
    )


def split_info(documents: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    n = _count(chunk_size)
    return documents.select(
        "doc_id", "total_pages", (F.col("total_pages") > MAX_PAGES).alias("needs_splitting"), n.alias("num_chunks"), F.lit(_size(chunk_size)).alias("chunk_size"),
        F.bround(n * F.lit(COST_PER_CHUNK), 3).alias("estimated_cost"), F.bround(n * F.lit(SECONDS_PER_CHUNK), 1).alias("estimated_time"),
    )


def chunk_metrics(results: DataFrame) -> DataFrame:
    """``(doc_id, chunk_index, success, processing_time)`` to counts, cost of the successful chunks, and time."""
    ok = F.col("success")
    return results.groupBy("doc_id").agg(
        F.count("*").alias("num_chunks"), F.count_if(ok).alias("successful_chunks"), (F.count_if(ok) > 0).alias("success"),
        F.bround(F.count_if(ok) * F.lit(COST_PER_CHUNK), 3).alias("total_cost"),
        F.bround(F.coalesce(F.sum(F.when(ok, F.col("processing_time"))), F.lit(0.0)), 2).alias("processing_time"),
    )


def merge_chunks(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Shifts the page columns that rows have by the first page of their chunk."""
    starts = plan.select("doc_id", "chunk_index", (F.col("page_start") - 1).alias("_off"))
    out = rows.join(starts, ["doc_id", "chunk_index"])
    return out.withColumns({c: F.col(c) + F.col("_off") for c in ("page", "page_start", "page_end") if c in rows.columns}).drop("_off")


def merge_totals(results: DataFrame) -> DataFrame:
    """``(doc_id, chunk_index, tables, clauses, processing_time, cost_estimate)``, counts per chunk, to the totals of the merged document."""
    total = lambda c, digits: F.bround(F.coalesce(F.sum(c), F.lit(0.0)), digits)
    return results.groupBy("doc_id").agg(
        F.coalesce(F.sum("tables"), F.lit(0)).alias("table_count"), F.coalesce(F.sum("clauses"), F.lit(0)).alias("clause_count"),
        total("processing_time", 2).alias("processing_time"), total("cost_estimate", 3).alias("cost_estimate"), F.count("*").alias("num_chunks"),
    )


def gpu_cost(seconds: str = "seconds"):
    return F.bround(F.col(seconds) / 3600 * GPU_DOLLARS_PER_HOUR, 4)
