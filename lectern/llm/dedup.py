"""Exact deduplication: 128-bit content hash, smallest id stays, bytes compared."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, join_groups, one_of_repeated, prepare, row_key, without_rows

_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalised(text: bytes | None) -> bytes:
    """UTF-8 in which every run of ASCII white space is one space."""
    text = (text or b"").translate(_BLANKS)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def content_hash(norm: bytes) -> bytes:
    """128 bits of content."""
    return hashlib.md5(norm).digest()


def _hashed(docs: DataFrame, id_col: str, text_col: str, hash_fn: Callable[[bytes], bytes], with_text: bool) -> DataFrame:
    """``(_id, _x, _h)`` and the digest, or the normalised bytes, of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    last = "_norm binary" if with_text else "_sha string"

    def run(batches):
        for batch in batches:
            norm = [normalised(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            own = pa.array(norm, pa.binary()) if with_text else pa.array([hashlib.sha256(t).hexdigest() for t in norm], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hash_fn(t) for t in norm], pa.binary()), own], ["_id", "_x", "_h", last.split()[0]])

    rows = docs.select(F.col(id_col).alias("_id"), row_key(text_col).alias("_x"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, _x long, _h binary, {last}")


def _members(docs: DataFrame, id_col: str, text_col: str, hash_fn: Callable[[bytes], bytes]) -> DataFrame:
    """``(_id, _x, _sha, keep_id, group_size)`` of every row."""
    prepare(docs.sparkSession)
    narrow = _hashed(docs, id_col, text_col, hash_fn, False).checkpoint()
    total = narrow.count()
    shared = narrow.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
    texts = join_groups(_hashed(docs, id_col, text_col, hash_fn, True), shared, "_h", "n", total, ["_id", "_x"], counted=True).drop("n")
    groups = texts.groupBy("_h", "_norm").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = groups.select("_h", "keep_id", "group_size").checkpoint()
    odd = found.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    clash = not odd.isEmpty()
    plain = narrow.join(if_small(odd), "_h", "left_anti") if clash else narrow
    sole = found.join(odd, "_h", "left_anti") if clash else found
    alone = F.col("group_size").isNull()
    members = join_groups(plain, sole, "_h", "group_size", total, ["_id", "_x"], "left").select(
        "_id", "_x", "_sha", F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")
    )
    if clash:
        ours = texts.join(odd, "_h", "left_semi").join(groups.join(odd, "_h", "left_semi"), ["_h", "_norm"])
        members = members.unionByName(ours.select("_id", "_x", F.sha2("_norm", 256).alias("_sha"), "keep_id", "group_size"))
    return members


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[bytes], bytes] = content_hash) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    1. One pass turns every text into its id, 128-bit hash and digest; hashes are counted.
    2. Only rows of hashes that occur twice send their texts, which are grouped by hash *and* bytes, so
       a hash that two different texts share still gives two groups. Equal texts collapse inside each
       map task: a group with a third of all rows sends one row per task.
    3. Groups are joined to the narrow rows of step 1; hashes with very many rows in pieces
       (:func:`join_groups`). Should a hash hold several texts, its rows are joined on their bytes.

    Texts may be of any length that a row holds. Null texts count as empty. A null id wins a group only
    if it has no other id. ``kept`` marks the rows that have the group's id, so also rows that repeat an
    id with the same text. An empty table gives no rows; other columns are not read.
    """
    return _members(docs, id_col, text_col, hash_fn).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows with equal texts one stays, with all its columns: that with the smallest id.

    Rows go by their own id and text, so rows that repeat an id with another text stay, as do rows with
    a null id whose text no other row has; of rows that repeat an id and the text one stays.
    """
    marks = _members(docs, id_col, text_col, content_hash).checkpoint()
    won = F.col("_id").eqNullSafe(F.col("keep_id"))
    gone = marks.where(~won).select(F.col("_id").alias("id"), F.col("_x").alias("x"))
    tied = marks.where(won & (F.col("group_size") > 1)).groupBy("_id", "_sha").agg(F.min("_x").alias("first"), F.collect_set("_x").alias("xs"), F.count("*").alias("n")).where("n > 1").checkpoint()
    gone = gone.union(tied.select("_id", F.explode(F.array_remove("xs", F.col("first")))))
    left = without_rows(docs, gone.checkpoint(), id_col, text_col)
    return one_of_repeated(left, tied.select(F.col("_id").alias("id"), F.col("first").alias("x")), id_col, text_col)
