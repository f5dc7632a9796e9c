"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, U64, folded, join_groups, mix64, multipliers, prepare, row_key, shingle_positions, without_rows, words_of

HASHES = 40
FACTORS = multipliers(HASHES, 23)
_TAGS = mix64(np.arange(1, HASHES + 1, dtype=U64))
#: Items of up to this many shingle positions are found by shingles of theirs, not by minima of windows.
SHORT = 8
LEAST_CLASS = 2 * SHORT
#: The size that stands for items found by their shingles.
BY_SHINGLES = 0
#: The filter of item keys has 2**24 to 2**27 bits (16 MB), whatever the number of items.
FILTER_BITS = (24, 27)
#: Words of documents whose minima are taken together, a power of two; a longer document is read in stretches.
AT_ONCE = 1 << 15


def size_class(positions: int) -> int:
    """The power of two that an item's number of shingle positions does not exceed."""
    size = LEAST_CLASS
    while size < positions:
        size *= 2
    return size


def keys_of(least: np.ndarray, size: int) -> np.ndarray:
    """64-bit keys of (size class, hash number, least value), from values whose last axis is the hash number."""
    return mix64(least ^ _TAGS ^ U64(size * 0x9E3779B9))


def shingle_keys(values: np.ndarray) -> np.ndarray:
    """64-bit keys of single shingles."""
    return mix64(values ^ U64(0xC2B2AE3D27D4EB4F))


def item_keys(at: np.ndarray, threshold: float) -> tuple[int, np.ndarray]:
    """Size and keys of an item with the given shingle values.

    Of an item's n distinct shingles a document must hold ceil(threshold * n), so it holds one at
    least of any n + 1 less that many: these are the keys of short items, and of those that repeat
    so many shingles that their minima would seldom equal a window's. None of their pairs is missed.
    """
    own, size = np.unique(at), size_class(len(at))
    if len(at) > SHORT and 2 * len(own) > size:
        return size, keys_of(np.array([(at * f).min() for f in FACTORS], dtype=U64), size)
    needed = max(1, int(np.ceil(threshold * len(own) - 1e-9)))
    return BY_SHINGLES, shingle_keys(own[: max(1, len(own) - needed + 1)])


def block_minima(documents: list[np.ndarray], size: int) -> list[np.ndarray]:
    """For each document's shingle values (blocks, HASHES): the least of each hash over every stretch of ``size`` positions."""
    counts = [-(-len(v) // size) for v in documents]
    padded = np.concatenate([np.concatenate([v, np.repeat(v[-1:], n * size - len(v))]) for v, n in zip(documents, counts, strict=True)])
    columns = np.ascontiguousarray(padded.reshape(-1, size).T)
    out = np.empty((columns.shape[1], HASHES), dtype=U64)
    step = max(1, 16384 // size)
    for at in range(0, columns.shape[1], step):
        part = columns[:, at : at + step]
        for k in range(HASHES):
            out[at : at + step, k] = (part * FACTORS[k]).min(axis=0)
    return np.split(out, np.cumsum(counts)[:-1])


def window_keys(least: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Keys of all windows of a document, from its block minima for the first size: windows of twice each size, one size apart."""
    out, own = [], sizes[0]
    for size in sizes:
        while own < size:
            if len(least) % 2:
                least = np.concatenate([least, least[-1:]])
            least, own = np.minimum(least[0::2], least[1::2]), own * 2
        windows = np.minimum(least[:-1], least[1:]) if len(least) > 1 else least
        out.append(keys_of(windows, size).ravel())
    return np.concatenate(out)


def _bits(keys: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U64((1 << log2) - 1)
    return keys & mask, (keys >> U64(32)) & mask


def in_filter(bitmap: np.ndarray, log2: int, keys: np.ndarray) -> np.ndarray:
    one, two = _bits(keys, log2)
    hit = np.flatnonzero((bitmap[(one >> U64(6)).astype(np.int64)] >> (one & U64(63))) & U64(1))
    two = two[hit]
    return hit[((bitmap[(two >> U64(6)).astype(np.int64)] >> (two & U64(63))) & U64(1)).astype(bool)]


def document_hits(at: np.ndarray, sizes: list[int], hits_of) -> list[np.ndarray]:
    """Hits of the window keys of one long document, by stretches that overlap by the largest size, so that every window lies in one."""
    span = max(AT_ONCE, 2 * sizes[-1])
    return [hits_of(window_keys(block_minima([at[a : a + span + sizes[-1]]], sizes[0])[0], sizes)) for a in range(0, len(at), span)]


def index_items(items: DataFrame, item_col: str, text_col: str, threshold: float = SIMILARITY) -> DataFrame:
    """``(item, width, size, keys, shingles)`` of the items that have a word: shingles of five words, or one of all words if there are fewer."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(folded(text.as_py()))[0]
                if len(words):
                    at = shingle_positions(words)
                    size, keys = item_keys(at, threshold)
                    rows.append((item, min(len(words), SHINGLE_WORDS), size, keys.view(np.int64), np.unique(at).tobytes()))
            cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["item", "width", "size", "keys", "shingles"])

    kind = items.schema[item_col].dataType.simpleString()
    return items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).distinct().mapInArrow(run, f"item {kind}, width long, size long, keys array<long>, shingles binary")


def _filter(index: DataFrame) -> tuple[np.ndarray, int]:
    """A two-bit Bloom filter of all item keys, put together by a bitwise aggregation."""
    entries = index.agg(F.sum(F.size("keys")).alias("n")).first()["n"] or 0
    log2 = min(FILTER_BITS[1], max(FILTER_BITS[0], int(max(entries, 1) * 32 - 1).bit_length()))
    key = F.col("k")
    mask = F.lit((1 << log2) - 1)
    both = index.select(F.explode("keys").alias("k")).select(
        F.explode(F.array(key.bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask))).alias("bit")
    )
    slots = both.select(F.shiftright("bit", 6).alias("slot"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("b")).groupBy("slot").agg(F.expr("bit_or(b)").alias("b"))
    bitmap = np.zeros(1 << (log2 - 6), dtype=np.int64)
    got = slots.toPandas()
    bitmap[got["slot"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return bitmap.view(U64), log2


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, threshold: float) -> DataFrame:
    """``(doc, x, item, n_shared, n_item)`` of the pairs that reach the threshold; x tells rows of one id apart."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    index = index_items(items, item_col, item_text_col, threshold).checkpoint()
    shapes = index.select("size", "width").distinct().collect()  # powers of two, and widths up to five
    sizes, short = sorted({r["size"] for r in shapes}), sorted({r["width"] for r in shapes} - {SHINGLE_WORDS})
    by_shingles, windowed = BY_SHINGLES in sizes, [x for x in sizes if x != BY_SHINGLES]
    if not sizes:
        return spark.createDataFrame([], f"doc {kind}, x long, item {item_kind}, n_shared long, n_item long")
    shared = spark.sparkContext.broadcast(_filter(index))
    none = np.zeros(0, dtype=U64)

    def scan(batches):
        bitmap, log2 = shared.value

        def hits_of(keys):
            return keys[in_filter(bitmap, log2, keys)]

        def finished(held):
            """(doc, x, keys, shingles) of the documents that the filter lets through."""
            small = [at for _, _, _, at in held if len(at) <= AT_ONCE and len(at)]
            minima = iter(block_minima(small, windowed[0]) if windowed and small else [])
            for doc, x, words, at in held:
                found = []
                if windowed and len(at):
                    found += document_hits(at, windowed, hits_of) if len(at) > AT_ONCE else [hits_of(window_keys(next(minima), windowed))]
                if by_shingles and len(at):
                    found.append(hits_of(shingle_keys(at)))
                runs = [shingle_positions(words, w) for w in short if len(words) >= w]
                found += [hits_of(shingle_keys(r)) for r in runs]
                hits = np.unique(np.concatenate([none, *found]))
                if len(hits):
                    yield doc, x, hits.view(np.int64), np.unique(np.concatenate([at, *runs])).tobytes()

        for batch in batches:
            rows, held, waiting = [], [], 0
            for doc, x, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words_of(folded(text.as_py()))[0]
                if len(words):
                    held.append((doc, x, words, shingle_positions(words) if len(words) >= SHINGLE_WORDS else none))
                    waiting += len(words)
                if waiting >= AT_ONCE:
                    rows += finished(held)
                    held, waiting = [], 0
            rows += finished(held)
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc", "x", "keys", "own"])

    rows = docs.select(F.col(id_col).alias("doc"), row_key(text_col).alias("x"), F.col(text_col).cast("string").alias("text"))
    hits = rows.mapInArrow(scan, f"doc {kind}, x long, keys array<long>, own binary").withColumn("row", F.monotonically_increasing_id()).checkpoint()
    keys = hits.select("row", F.explode("keys").alias("k"))
    n_keys = hits.agg(F.sum(F.size("keys")).alias("n")).first()["n"] or 0
    lookup = index.select("item", F.explode("keys").alias("k")).join(keys.groupBy("k").agg(F.count("*").alias("n")), "k")
    pairs = join_groups(keys, lookup, "k", "n", n_keys, ["row"], unique=False).select("row", "item").distinct().checkpoint()
    wanted = index.select("item", "shingles").join(pairs.groupBy("item").agg(F.count("*").alias("n")), "item")
    both = join_groups(pairs, wanted, "item", "n", pairs.count(), ["row"], unique=False).join(hits.select("row", "doc", "x", "own"), "row")

    def verify(batches):
        for batch in batches:
            n, m = [], []
            for q, x in zip(batch.column("shingles"), batch.column("own"), strict=True):
                q, x = (np.frombuffer(v.as_buffer(), dtype=U64) for v in (q, x))
                at = np.minimum(np.searchsorted(x, q), len(x) - 1)
                n.append(int((x[at] == q).sum()))
                m.append(len(q))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("x"), batch.column("item"), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["doc", "x", "item", "n_shared", "n_item"])

    found = both.select("doc", "x", "item", "shingles", "own").mapInArrow(verify, f"doc {kind}, x long, item {item_kind}, n_shared long, n_item long")
    return found.where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    threshold: float = SIMILARITY,
) -> DataFrame:
    """Pairs of a document and an item of whose distinct 5-word shingles it holds ``threshold`` or more.

    A row per pair: id, item id, ``n_shared``, ``n_item``, ``containment``. Long documents against
    short items have a Jaccard similarity near zero, which MinHash cannot find; so items are parted by
    size (powers of two of shingle positions, from 16), and for each size that occurs documents are cut into
    windows of twice that size, one size apart: a passage of an item lies whole in one of them, with a
    similarity of 0.19 at the least (0.25 for a whole passage). One of 40 equal MinHash values makes
    a candidate: 0.02 % of pairs at the bound are missed, 0.001 % of whole passages. Items of up to 8
    positions, and those that repeat their shingles, are looked up by their shingles instead, and
    none of their pairs is missed (:func:`item_keys`). An item of under five words has one shingle, of
    all its words, and is contained where they follow one another.

    Every document is read once, long ones in stretches; window keys that pass a filter of the items'
    keys (16 MB at most, a fixed bound) leave the scan, with the shingles of their document. Keys and
    items that a third of all documents hold are joined in pieces (:func:`join_groups`), and the
    whole document's shingles decide. Items without a word match nothing; null texts are empty and
    match nothing; repeated rows of items count once and repeated document ids count as one document
    each time they match, with or without an id. Empty tables give no rows.
    """
    return _found(docs, items, id_col, text_col, item_col, item_text_col, threshold).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = SIMILARITY) -> DataFrame:
    """The documents that hold no item, with all their columns. Rows go by their own id and text, whether they have an id or share it."""
    found = _found(docs, items, id_col, text_col, item_col, "text", threshold)
    return without_rows(docs, found.select(F.col("doc").alias("id"), "x").distinct().checkpoint(), id_col, text_col)


def oracle(threshold: float = SIMILARITY) -> str:
    """All shared shingles counted, in SQL."""
    words = r"regexp_extract_all(regexp_replace(lower(text), '[\x{80}-\x{a9}\x{ab}-\x{b4}\x{b6}-\x{b9}\x{bb}-\x{bf}\x{d7}\x{f7}\x{2000}-\x{206f}\x{3000}-\x{303f}\x{feff}]', ' ', 'g'), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')"
    n = SHINGLE_WORDS
    return f"""
        WITH q AS (
                SELECT DISTINCT id, least(len(w), {n}) AS k, unnest(list_transform(range(1, greatest(len(w) - {n - 2}, 2)), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS s
                FROM (SELECT item_id AS id, {words} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)) WHERE len(w) > 0),
             x AS (
                SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
                FROM (SELECT doc_id AS id, {words} AS w FROM documents), (SELECT DISTINCT k FROM q) WHERE len(w) >= k),
             size AS (SELECT id, count(*) AS n_item FROM q GROUP BY id)
        SELECT x.id AS doc_id, q.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item,
               count(*)::DOUBLE / any_value(n_item) AS containment
        FROM q JOIN x USING (s, k) JOIN size ON size.id = q.id
        GROUP BY x.id, q.id HAVING count(*) >= {threshold} * any_value(n_item) - 1e-9"""
