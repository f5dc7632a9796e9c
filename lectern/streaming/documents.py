"""A stream of page texts, structured batch by batch: a document is whole in one row, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import clauses as C

DOCUMENT = "doc_id string, pages array<string>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).json(path)


def structure_stream(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the clauses of each arriving document to Parquet files under out; a replayed batch overwrites its own folder."""

    def batch(frame: DataFrame, number: int) -> None:
        pages = frame.select("doc_id", F.posexplode("pages").alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")
        C.clauses(C.page_lines(pages)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
