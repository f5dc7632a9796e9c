"""Byte-level BPE by overlapping chunks: pre-tokenise in parallel, stitch where boundaries meet, merge, decode."""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import prepare

CHUNK, OVERLAP = 1 << 16, 1 << 9
#: A boundary this near to the end of what a chunk sees may move when more is seen.
MARGIN = 4
CACHE = 1 << 18
#: Longer pre-tokens, in bytes, are merged one by one; short texts of so many characters are merged together.
SHORT, TOGETHER = 64, 1 << 19
NONE = 1 << 40
#: A text of more characters is cut into parts of PART, each with PART_OVERLAP of the next, that are encoded by tasks of their own.
LONG, PART, PART_OVERLAP = 1 << 20, 1 << 18, 1 << 12
#: Characters of parts that leave a task at a time.
PARTS_AT_ONCE = 1 << 23


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def chunk_boundaries(pattern, text: str, start: int, end: int) -> list[int]:
    """Ends of the pre-tokens found from start on, those that what lies beyond end cannot change."""
    sure = end if end == len(text) else end - MARGIN
    return [m.end() for m in pattern.finditer(text, start, end) if m.end() <= sure]


def pretokenise(pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """The pre-tokens of a text, chunk by chunk.

    Every chunk is split on its own, from its first character to some way into the next chunk, so the
    splits depend on nothing but their characters. A chunk's split may start inside a pre-token; from
    the first boundary that it shares with the one before, both are the same, as the pattern looks
    only ahead. There one chunk hands over to the next. If they share none in the overlap (one very
    long pre-token), the overlap doubles.
    """
    n = len(text)
    if n <= chunk + overlap:
        yield pattern.findall(text)
        return
    begin, at = 0, 0
    mine = chunk_boundaries(pattern, text, 0, chunk + overlap)
    while at + chunk < n and begin < n:
        limit = at + chunk
        seen = min(n, limit + chunk + overlap)
        theirs = chunk_boundaries(pattern, text, limit, seen)
        shared, reach = set(theirs), overlap
        while (meet := next((b for b in mine if b > limit and b in shared), None)) is None:
            reach *= 2
            mine = chunk_boundaries(pattern, text, begin, min(n, limit + reach))
            if limit + reach > seen:
                seen = min(n, limit + reach)
                theirs = chunk_boundaries(pattern, text, limit, seen)
                shared = set(theirs)
        cuts = [begin, *(b for b in mine if b <= meet)]
        yield [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        begin, at, mine = meet, limit, [b for b in theirs if b > meet]
    cuts = [begin, *mine]
    yield [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Codec:
    """Encodes and decodes with a table of merge ranks. Broadcast whole: a worker keeps its cache from task to task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.raw = {i: b for b, i in ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {(ranks[b[:k]] << 32) + ranks[b[k:]]: i for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}
        order = np.argsort(keys := np.fromiter(pairs.keys(), np.int64, len(pairs)))
        self.keys, self.values = np.append(keys[order], np.int64(-1)), np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], NONE)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what two adjacent ids make (NONE: nothing)."""
        key = (left << 32) + right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of pre-tokens: of all adjacent pairs, the one of lowest rank is joined first, leftmost on ties.

        Those of one length are a matrix of ids, a row each; a step joins one pair in every row.
        """
        out, sized = [b""] * len(pieces), defaultdict(list)
        for k, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > SHORT:
                out[k] = np.array(self._merge_long(piece), dtype="<u4").tobytes()
            else:
                sized[len(piece)].append(k)

        def put(at, ids):
            flat, wide = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
            for n, k in enumerate(at.tolist()):
                out[k] = flat[n * wide : (n + 1) * wide]

        for size, own in sized.items():
            at = np.array(own)
            ids = self.single[np.frombuffer(b"".join(pieces[k] for k in own), dtype=np.uint8).reshape(-1, size)]
            rank = self.rank_of(ids[:, :-1], ids[:, 1:])
            while len(at) and rank.shape[1]:
                best = rank.argmin(axis=1)
                joined = rank[np.arange(len(at)), best]
                if (done := joined == NONE).any():
                    put(at[done], ids[done])
                    at, ids, rank, best, joined = (x[~done] for x in (at, ids, rank, best, joined))
                    if not len(at):
                        break
                row = np.arange(len(at))
                ids[row, best] = joined
                ids = ids[np.arange(ids.shape[1]) != best[:, None] + 1].reshape(len(at), -1)
                rank = rank[np.arange(rank.shape[1]) != best[:, None]].reshape(len(at), ids.shape[1] - 1)
                for first in (best - 1, best):
                    there = (first >= 0) & (first < rank.shape[1])
                    r, f = row[there], first[there]
                    rank[r, f] = self.rank_of(ids[r, f], ids[r, f + 1])
            put(at, ids)
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for long pre-tokens, by a heap and linked neighbours."""
        import heapq

        n, get = len(piece), self.ranks.get
        end, last = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, to = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != to or not alive[end[i]]:
                continue
            if get(piece[i:to]) != rank:
                continue
            gone = end[i]
            alive[gone], end[i] = False, to
            if to < n:
                last[to] = i
                if (r := get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if last[i] >= 0 and (r := get(piece[last[i] : to])) is not None:
                heapq.heappush(heap, (r, last[i], to))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each pre-token; short ones are kept."""
        out = list(map(self.cache.get, pieces))
        if None in out:
            new = list({p for p, x in zip(pieces, out, strict=True) if x is None})
            got = dict(zip(new, self.merged([p.encode("utf-8", "replace") for p in new]), strict=True))
            out = [got[p] if x is None else x for p, x in zip(pieces, out, strict=True)]
            if len(self.cache) + len(got) > CACHE:
                self.cache.clear()
            self.cache.update((p, x) for p, x in got.items() if len(p) <= SHORT)
        return out

    def encode_chunks(self, text: str | None) -> Iterator[bytes]:
        for pieces in pretokenise(self.pattern, text or ""):
            yield b"".join(self.ids_of(pieces))

    def encode_texts(self, texts: Iterator[str | None]) -> Iterator[Iterator[bytes]]:
        """Per text its ids, piece by piece; texts of one chunk are merged together, longer ones stream by themselves."""
        held, size = [], 0
        for text in texts:
            if (alone := len(text or "") > CHUNK) or size > TOGETHER:
                yield from self._together(held)
                held, size = [], 0
            if alone:
                yield self.encode_chunks(text)
            else:
                held.append(self.pattern.findall(text or ""))
                size += len(text or "")
        yield from self._together(held)

    def _together(self, held: list[list[str]]) -> Iterator[Iterator[bytes]]:
        ids, at = self.ids_of(list(chain.from_iterable(held))), 0
        for pieces in held:
            yield iter((b"".join(ids[at : at + len(pieces)]),))
            at += len(pieces)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_chunks(text)), dtype="<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.asarray(ids).tolist()))


class Digest:
    """Count, hash of ids and hash of decoded bytes of one text, from its ids piece by piece."""

    def __init__(self, codec: Codec, with_ids: bool):
        self.codec, self.n, self.one, self.two, self.ids = codec, 0, hashlib.sha256(), hashlib.sha256(), [] if with_ids else None

    def add(self, part: bytes) -> None:
        got = np.frombuffer(part, dtype="<u4")
        self.n += len(got)
        self.one.update(part)
        self.two.update(self.codec.decode(got))
        if self.ids is not None:
            self.ids.append(got.astype(np.int32))

    def row(self) -> tuple:
        own = () if self.ids is None else (np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32),)
        return self.n, self.one.hexdigest(), self.two.hexdigest(), *own


def _result(id_col: str, ids: pa.Array, rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * (3 + with_ids)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 3 + with_ids]
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)


def _by_row(frame: DataFrame, column: str, work, schema: str) -> DataFrame:
    """Runs work(id, values) on each ``row``'s values of a column, which stream by in the order of ``part``."""
    dealt = frame.select("row", "part", "id", column).repartition("row").sortWithinPartitions("row", "part")

    def run(batches):
        flat = (v for batch in batches for v in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, parts in groupby(flat, key=lambda v: v[0]):
            first = next(parts)
            yield work(first[2], (v[3] for v in chain([first], parts)))

    return dealt.mapInArrow(run, schema)


def _long_texts(docs: DataFrame, shared, id_col: str, text_col: str, with_ids: bool, schema: str) -> DataFrame | None:
    """Rows of :func:`tokenise` for the texts of more than LONG characters; None if there are none.

    1. Texts are cut into parts, rows of their own, and every part is split into pre-tokens from its
       first character on.
    2. Where a part's boundaries and the next one's agree in their overlap, the one hands over to the
       other: each part then has a begin and an end.
    3. Parts are encoded from begin to end, by any task.
    4. A text's ids stream in order through one task, which takes their hashes; nothing is gathered.

    A text with parts that share no boundary (a pre-token of more than 4,096 characters) is encoded by
    one task, whose chunks overlap as far as it takes.
    """
    kind = docs.schema[id_col].dataType
    arrow = pa.field("id", to_arrow_type(kind)).type

    def cut(batches):
        for batch in batches:
            for row, own, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                starts = range(0, len(text), PART)
                for k in range(0, len(starts), max(1, PARTS_AT_ONCE // PART)):
                    some = starts[k : k + max(1, PARTS_AT_ONCE // PART)]
                    columns = [pa.array([row] * len(some)), pa.array([own.as_py()] * len(some), arrow), pa.array([a // PART for a in some], pa.int64()), pa.array([a + PART + PART_OVERLAP >= len(text) for a in some]), pa.array([text[a : a + PART + PART_OVERLAP] for a in some])]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "id", "part", "last", "text"])

    name = kind.simpleString()
    wide = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > LONG)
    parts = wide.mapInArrow(cut, f"row long, id {name}, part long, last boolean, text string").checkpoint()
    if parts.isEmpty():
        return None

    def split(batches):
        pattern = shared.value.pattern
        for batch in batches:
            heads, tails = [], []
            for last, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ends = np.array([m.end() for m in pattern.finditer(text) if last or m.end() <= len(text) - MARGIN], dtype=np.int64)
                heads.append(ends[ends <= PART_OVERLAP])
                tails.append(ends[ends > PART] - PART)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.list_(pa.int64())) for x in (heads, tails))], ["row", "part", "head", "tail"])

    edges = parts.select("row", "part", "last", "text").mapInArrow(split, "row long, part long, head array<long>, tail array<long>").checkpoint()
    follows = edges.select("row", (F.col("part") - 1).alias("part"), F.col("head").alias("next"))
    meets = edges.join(follows, ["row", "part"]).select("row", "part", F.array_min(F.array_intersect("tail", "next")).alias("meet"))
    broken = meets.where("meet IS NULL").select("row").distinct()
    begins = meets.select("row", (F.col("part") + 1).alias("part"), F.col("meet").alias("begin"))
    placed = parts.join(broken, "row", "left_anti").join(begins, ["row", "part"], "left").join(meets, ["row", "part"], "left")

    def encode(batches):
        codec = shared.value
        for batch in batches:
            out = []
            for begin, meet, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                begin, end = begin or 0, len(text) if meet is None else meet + PART
                ends = [m.end() for m in codec.pattern.finditer(text, begin)]
                cuts = [begin, *(b for b in ends if b <= end)]
                out.append(b"".join(codec.ids_of([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["row", "part", "id", "ids"])

    def finish(own, pieces):
        digest = Digest(shared.value, with_ids)
        for piece in pieces:
            digest.add(piece)
        return _result(id_col, pa.array([own], arrow), [digest.row()], with_ids)

    def whole(own, texts):
        codec = shared.value
        digest = Digest(codec, with_ids)
        for piece in codec.encode_chunks("".join(t[:PART] for t in texts)):
            digest.add(piece)
        return _result(id_col, pa.array([own], arrow), [digest.row()], with_ids)

    coded = placed.select("row", "part", "id", "begin", "meet", "text").mapInArrow(encode, f"row long, part long, id {name}, ids binary")
    return _by_row(coded, "ids", finish, schema).unionByName(_by_row(parts.join(broken, "row", "left_semi"), "text", whole, schema))


def tokenise(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and ``ids`` (array of int) on request.

    The driver reads the vocabulary (about a megabyte, fixed by its file) and broadcasts the codec made of it (10 MB). A text
    streams through in overlapping chunks: ids and decoded bytes are hashed chunk by chunk, so memory
    is bounded by the batch, not by token counts. Texts of more than a million characters are cut into
    overlapping parts that tasks split and encode side by side (:func:`_long_texts`). Null text counts
    as empty: no tokens, and the hash of no bytes. Repeated rows give repeated rows, a null id is kept;
    other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Codec(load_ranks(vocabulary), pattern))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        codec = shared.value
        for batch in batches:
            rows = []
            for parts in codec.encode_texts(text.as_py() for text in batch.column(1)):
                digest = Digest(codec, with_ids)
                for part in parts:
                    digest.add(part)
                rows.append(digest.row())
            yield _result(id_col, batch.column(0), rows, with_ids)

    short = docs.select(id_col, text_col).where(F.coalesce(F.length(text_col), F.lit(0)) <= LONG).mapInArrow(run, schema)
    long = _long_texts(docs, shared, id_col, text_col, with_ids, schema)
    return short if long is None else short.unionByName(long)
