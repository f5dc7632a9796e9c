"""WARC archives: written by Spark's text writer, read back by boundary-chain verification."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, prepare, remove_path, scratch_path

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
MIN_REVISIT = 1000
FILE_BYTES = 32 << 20
CHUNK = 1 << 20
MAX_ROUNDS = 40


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Adds to each page its payload's size and digest, and for copies the page that they revisit.

    Of pages with equal payloads of at least ``least`` bytes, that with the largest id is the
    response; the others refer to it. Payloads are equal when SHA-1 and SHA-256 are. Groups are partial
    aggregates of digests, and the join back is on the digest, in pieces if very many pages are one
    payload (:func:`join_groups`). Null html is an empty payload; rows that repeat a page id and payload
    are all responses; a null id never wins a group and, as a revisit, refers to the winner's.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1("html")})
    rows = rows.withColumn("payload", F.when(F.col("bytes") >= least, F.concat("digest", F.sha2("html", 256))).otherwise(F.hex(F.xxhash64("page_id", "url"))))
    groups = rows.where(F.col("bytes") >= least).groupBy("payload").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").checkpoint()
    joined = join_groups(rows, groups, "payload", "n", groups.agg(F.sum("n").alias("n")).first()["n"] or 0, ["page_id"], "left", counted=True)
    return joined.select(
        "page_id", "url", "html", "bytes", "digest",
        F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )


def record(date: str = "2024-01-01T00:00:00Z") -> Column:
    """The text of a WARC record without its closing blank lines, from the columns of :func:`plan_records`."""
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", "%20")
    return F.concat(
        F.lit(MAGIC.decode()),
        F.when(revisit, F.lit("WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(
            F.lit("WARC-Type: response\r\n")
        ),
        F.lit("WARC-Record-ID: "), urn("page_id"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("refers_to"), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("WARC-Target-URI: "), url, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nWARC-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block,
    )


def write_archives(records: DataFrame, path: str, file_bytes: int | None = None) -> None:
    """Writes records as uncompressed WARC files; the blank lines after a record are the line separator.

    Each task begins a new file (folder ``file=n`` under path) before a record that would take the one
    at hand past ``file_bytes``, so only a record that is larger by itself makes a larger file.
    """
    most = file_bytes or FILE_BYTES

    def deal(batches):
        number, held = 0, 0
        for batch in batches:
            files = []
            for size in pc.binary_length(batch.column(0)).to_pylist():
                if held and held + size + len(END) > most:
                    number, held = number + 1, 0
                held += size + len(END)
                files.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.int32())], ["value", "file"])

    records.select(record().alias("value")).mapInArrow(deal, "value string, file int").write.option("lineSep", END.decode()).partitionBy("file").text(path)


_FIELD = re.compile(rb"(?im)^(warc-type|warc-record-id|warc-refers-to|warc-payload-digest|warc-payload-length|content-length|warc-target-uri):[ \t]*([^\r\n]*)\r$")


def headers(data: bytes):
    """(offset, end of the header block, fields) of every magic that a sound header of any length follows.

    Magics before the same blank line share its end; their fields are read once, and each has those
    behind it, so the time is in proportion to the length.
    """
    at, end, last = data.find(MAGIC), -1, {}
    while at >= 0:
        if end < at:
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                return
            last = {m[1].lower(): (m.start(), m[2]) for m in _FIELD.finditer(data, at + len(MAGIC), end + 2)}
        fields = {k: v for k, (place, v) in last.items() if place >= at + len(MAGIC)}
        if fields.get(b"content-length", b"").isdigit():
            yield at, end + 4, fields
        at = data.find(MAGIC, at + 1)


def candidates(data: bytes, chunk: int = CHUNK):
    """Every place that may begin a record: (offset, successor, fields, payload).

    A place counts if a magic stands there, a sound header follows, and the block that the header
    announces ends with blank lines inside the file.
    """
    for at, start, fields in headers(data):
        end = start + int(fields[b"content-length"])
        if end + 4 <= len(data) and data[end : end + 4] == b"\r\n\r\n":
            http = data.find(b"\r\n\r\n", start, end)
            yield at, end + 4, fields, (data[http + 4 : end] if http >= 0 else b"")


def chunk_forest(found: list[tuple[int, int]], chunk: int = CHUNK) -> list[tuple[int, int, int, int]]:
    """For each (offset, successor): its exit (the first place on its chain in another chunk) and its place in the chunk's forest.

    Inside a chunk the successors form a forest whose roots leave the chunk. (pre, post) are such
    that e's chain passes o exactly if pre[o] <= pre[e] <= post[o].
    """
    place = {o: i for i, (o, _) in enumerate(found)}
    exits, kids, roots = [0] * len(found), [[] for _ in found], []
    for i in range(len(found) - 1, -1, -1):
        o, s = found[i]
        j = place.get(s)
        if j is not None and s // chunk == o // chunk:
            exits[i] = exits[j]
            kids[j].append(i)
        else:
            exits[i] = s
            roots.append(i)
    pre, post, clock = [0] * len(found), [0] * len(found), 0
    stack = [(r, False) for r in roots]
    while stack:
        i, done = stack.pop()
        if done:
            post[i] = clock - 1
            continue
        pre[i] = clock
        clock += 1
        stack.append((i, True))
        stack += [(k, False) for k in kids[i]]
    return list(zip(exits, [o // chunk for o, _ in found], pre, post, strict=True))


_SCANNED = (
    "path string, at long, successor long, size long, leaves long, chunk long, pre long, post long, record_type string, record_id string, "
    "refers string, stated_digest string, stated_bytes long, payload_bytes long, payload_digest string"
)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)


def scan_archives(spark: SparkSession, path: str, chunk: int = CHUNK, with_payload: bool = False) -> DataFrame:
    """A row per candidate record of all files under path, sound or not."""
    files = archive_files(spark, path)
    schema = _SCANNED + ", payload binary" * with_payload

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer().to_pybytes()
                rows, spans = [], []
                for at, nxt, f, payload in candidates(data):
                    text = lambda k, f=f: f[k].decode("utf-8", "replace") if k in f else None
                    stated = f.get(b"warc-payload-length", b"")
                    spans.append((at, nxt))
                    rows.append([text(b"warc-type"), text(b"warc-record-id"), text(b"warc-refers-to"), text(b"warc-payload-digest"), int(stated) if stated.isdigit() else None, len(payload), hashlib.sha1(payload).hexdigest(), *[payload] * with_payload])
                links = chunk_forest(spans, chunk)
                table = [[name, *s, len(data), *x, *r] for s, x, r in zip(spans, links, rows, strict=True)]
                for k in range(0, len(table), 5000):
                    part = [*zip(*table[k : k + 5000], strict=True)]
                    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInArrow(run, schema)


def reachable_entries(found: DataFrame) -> DataFrame:
    """``(path, at)`` of the places where the chain from each file's start enters a chunk.

    Pointer jumping: pointers lead from an entry to the entry of a later chunk; each round the
    reached set takes one jump and all pointers double, so rounds grow with the logarithm of the
    number of chunks in a file.
    """
    nodes = found.select("path", "at", F.col("leaves").alias("to"))
    exits = nodes.select("path", F.col("to").alias("at")).distinct()
    jump = nodes.join(exits, ["path", "at"], "left_semi").unionByName(nodes.where("at = 0")).distinct().checkpoint()
    reached = jump.where("at = 0").select("path", "at").checkpoint()
    count = reached.count()
    for _ in range(MAX_ROUNDS):
        step = reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = reached.union(step).distinct().checkpoint()
        now = reached.count()
        if now == count:
            return reached
        count = now
        far = jump.select("path", F.col("at").alias("to"), F.col("to").alias("to2"))
        jump = jump.join(far, ["path", "to"], "left").select("path", "at", F.coalesce("to2", "to").alias("to")).checkpoint()
    raise RuntimeError("chains did not settle")


def check_ends(files: DataFrame, reached: DataFrame) -> None:
    """Raises if the chain from some file's start does not end at the file's end."""
    ends = reached.groupBy("path").agg(F.max("at").alias("ends"))
    short = files.select("path", "length").join(ends, "path", "left").where("length <> coalesce(ends, 0)").first()
    if short:
        raise ValueError(f"{short['path']}: the records end at byte {short['ends'] or 0} of {short['length']}")


def read_archives(spark: SparkSession, path: str, chunk: int = CHUNK, with_payload: bool = False) -> DataFrame:
    """The records of the WARC files under path: candidates that the chain from a file's start passes.

    Magic inside a payload gives a candidate at most, which no chain from a file's start passes.
    Files may have up to 2 GB (one binary value each); an empty folder gives no rows. A file whose
    records do not reach its end is an error.
    """
    found = scan_archives(spark, path, chunk, with_payload)
    found = found if with_payload else found.checkpoint()
    reached = reachable_entries(found)
    check_ends(archive_files(spark, path), reached)
    entries = reached.select("path", (F.col("at") / F.lit(chunk)).cast("long").alias("chunk"), F.col("at").alias("enters"))
    entry = found.select("path", F.col("at").alias("enters"), F.col("pre").alias("enter_pre")).join(entries, ["path", "enters"])
    return found.join(entry.drop("enters"), ["path", "chunk"]).where("enter_pre BETWEEN pre AND post").drop("enter_pre")


def page_rows(records: DataFrame) -> DataFrame:
    """The records as rows per page: id, payload size and digest (a revisit's as its header states), type, ``refers_to``."""
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1)
    revisit = F.col("record_type") == "revisit"
    return records.select(
        F.nullif(number("record_id"), F.lit("")).cast("long").alias("page_id"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated_digest", "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.nullif(F.coalesce(number("refers"), F.lit("")), F.lit("")).cast("long").alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep_at: str | None = None) -> DataFrame:
    """Writes a record per page into the shared folder, reads the archives back and gives :func:`page_rows`.

    The archives go when the rows are in a checkpoint, unless ``keep_at`` names a folder for them.
    """
    spark = pages.sparkSession
    prepare(spark)
    path = keep_at or scratch_path(spark, "warc")
    write_archives(plan_records(pages, id_col, url_col, html_col), path)
    rows = page_rows(read_archives(spark, path)).checkpoint()
    if keep_at is None:
        remove_path(spark, path)
    return rows
