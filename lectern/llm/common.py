"""What the operators share: inputs, shared scratch space, words and shingles."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import store
from ..functions.store import shared_folder

SHINGLE_WORDS = 5
SIMILARITY = 0.8

#: A key that holds more than a thousandth of all rows is dealt over several tasks: by counting, there are fewer than HOT such keys.
HOT = 1000
#: Tables of at most so many narrow rows (under 10 MB) are broadcast once they have been counted; larger ones are shuffled.
BROADCAST_ROWS = 100_000

#: Rows in an Arrow batch of texts, where the session has left Spark's 10,000: five times less memory in JVM and Python.
BATCH_ROWS = 2000

U64 = np.uint64
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Names a checkpoint folder if the session has none, and makes Arrow batches smaller if the session has left their default."""
    store.prepare(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/lectern-{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_checkpoint(frame: DataFrame) -> None:
    """Deletes the files of a frame that ``checkpoint()`` has returned and that nothing reads any more."""
    file = frame._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        remove_path(frame.sparkSession, file.get())


# --- joins ---------------------------------------------------------------------------------


def if_small(frame: DataFrame) -> DataFrame:
    """The (materialised, narrow) frame, to be broadcast if a count shows that it is small."""
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int, salt: list[str], how: str = "inner", counted: bool = False, unique: bool = True) -> DataFrame:
    """Joins rows with groups, one row per key (several unless ``unique``), where ``n`` is how many of the ``total`` rows have the key.

    Keys that many rows share never meet in one task: one with more than a thousandth of all rows is
    dealt by a hash of the rows' ``salt`` columns into pieces of about that many, and its group is
    copied to each. Only the names of these keys are broadcast; as their rows add up to the total,
    there are fewer than HOT. ``counted``: groups (materialised) are counted first, and broadcast
    whole if they are few.
    """
    if counted and groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key, how)
    pieces = F.ceil(F.col(n) / F.lit(max(total // HOT, HOT)))
    hot = groups.where(pieces > 1).select(key, pieces.alias("_pieces"))
    hot = hot if unique else hot.distinct()
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_piece", F.pmod(F.xxhash64(*salt), F.coalesce("_pieces", F.lit(1))))
    copied = groups.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(pieces, F.lit(1)) - 1)))
    return dealt.join(copied, [key, "_piece"], how).drop("_piece", "_pieces")


def row_key(text_col: str) -> Column:
    """What tells rows with the same id apart: a 64-bit hash of the text."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(text_col).isNull())


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id (null equals null) and :func:`row_key` are not together in ``gone`` (``id``, ``x``)."""
    gone = gone.select(F.col("id").alias("_gone_id"), F.col("x").alias("_gone_x"))
    return docs.join(if_small(gone.distinct()), docs[id_col].eqNullSafe(F.col("_gone_id")) & (row_key(text_col) == F.col("_gone_x")), "left_anti")


def one_of_repeated(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the rows whose id and :func:`row_key` are in ``repeated`` (``id``, ``x``), one each stays; all others stay."""
    if repeated.isEmpty():
        return docs
    again = if_small(repeated.select(F.col("id").alias("_gone_id"), F.col("x").alias("_gone_x")).distinct())
    same = docs[id_col].eqNullSafe(F.col("_gone_id")) & (row_key(text_col) == F.col("_gone_x"))
    ours = docs.join(again, same, "left_semi")
    one = ours.withColumn("_gone_x", row_key(text_col)).dropDuplicates([id_col, "_gone_x"]).select(docs.columns)
    return docs.join(again, same, "left_anti").unionByName(one)


# --- words ---------------------------------------------------------------------------------

#: Punctuation and spaces beyond ASCII that separate words: Latin-1 signs, general punctuation, CJK punctuation.
WIDE_GAPS = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u303f\ufeff]")

_BYTE_IS_WORD = np.zeros(256, dtype=bool)
_BYTE_IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_BYTE_IS_WORD[128:] = True
_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, _PIECE + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), _PIECE + 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def folded(text: str | None) -> bytes:
    """The text as words see it: lower case, wide punctuation as spaces, UTF-8."""
    text = (text or "").lower()
    if not text.isascii():
        text = WIDE_GAPS.sub(" ", text)
    return text.encode("utf-8", "replace")


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in folded bytes: runs of ASCII letters and digits and of what lies beyond ASCII."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _BYTE_IS_WORD[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _word_end(data: np.ndarray, at: int) -> int:
    """Where the word that goes on at ``at`` ends."""
    while at < len(data):
        gaps = np.flatnonzero(~_BYTE_IS_WORD[data[at : at + _PIECE]])
        if len(gaps):
            return at + int(gaps[0])
        at += _PIECE
    return len(data)


def _long_word(data: np.ndarray) -> np.ndarray:
    """The same hash for one word of any length."""
    total = 0
    for at in range(0, len(data), _PIECE):
        part = data[at : at + _PIECE]
        total += pow(_BASE, at, 1 << 64) * int((_BYTE_VALUE[part] * _POWER[: len(part)]).sum(dtype=U64))
    return mix64(np.array([total & MASK64], dtype=U64) + U64(len(data)))


def words_of(folded_bytes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of folded bytes, read in stretches of about _PIECE bytes that end between words."""
    data = np.frombuffer(folded_bytes, dtype=np.uint8)
    parts, at = [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        if end < len(data) and _BYTE_IS_WORD[data[end - 1]] and _BYTE_IS_WORD[data[end]]:
            gaps = np.flatnonzero(~_BYTE_IS_WORD[data[at:end]])
            if not len(gaps):
                end = _word_end(data, end)
                parts.append((_long_word(data[at:end]), np.array([at]), np.array([end])))
                at = end
                continue
            end = at + int(gaps[-1]) + 1
        own = data[at:end]
        s, e = word_spans(own)
        total = np.zeros(len(own) + 1, dtype=U64)
        np.cumsum(_BYTE_VALUE[own] * _POWER[: len(own)], out=total[1:])
        parts.append((mix64((total[e] - total[s]) * _INVERSE[s] + (e - s).astype(U64)), s + at, e + at))
        at = end
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=U64), none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_STEP = [U64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_positions(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The hash of every run of n words, in order; one hash of all words if there are fewer (so the empty text has one)."""
    width = min(n, len(words))
    count = max(1, len(words) - n + 1)
    acc = np.full(count, U64(width + 1))
    for j in range(width):
        acc = (acc ^ words[j : j + count]) * _STEP[j % len(_STEP)]
        acc ^= acc >> U64(32)
    return acc


def shingles(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_positions(words_of(folded(text))[0], n))


def multipliers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, count, dtype=U64) * U64(2) + U64(1)


def minhash(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least of each 32-bit hash over the values, in blocks that stay in the processor's cache."""
    least = np.full(len(factors), 0xFFFFFFFF, dtype=U64)
    for at in range(0, len(values), 512):
        block = values[None, at : at + 512] * factors[:, None]
        np.minimum(least, block.min(axis=1) >> U64(32), out=least)
    return least.astype(np.uint32)
