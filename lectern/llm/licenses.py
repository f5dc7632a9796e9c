"""License scans by canonical digest lookup, in DataFrame functions only."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import KNOWN_DIGESTS, KNOWN_LICENSES

#: A line that begins with a copyright mark, or with the word and a mark, year, colon, "by" or blank to fill in, or that reserves
#: rights; the text is lower case by then. Prose that only begins a line with "copyright notice" or "copyright holders" is none.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]*([(]c[)]|©|[12][0-9][0-9][0-9]|[<:\[]|by[ \t])|[(]c[)][ \t]*([12][0-9][0-9][0-9]|copyright)|©|all rights reserved)[^\n]*"

# Spellings that count as equal, from and to, applied in this order to words with one space between them.
EQUIVALENTS = [
    ("http ", "https "),
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("per cent", "percent"),
]
GAPS = r"[^\p{L}\p{N}]+"


def canonical(text: str | Column) -> Column:
    """Lower case, copyright lines gone, punctuation and line ends one space, then equivalent spellings made equal, trimmed."""
    out = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    out = F.translate(out, "\r", "\n")
    out = F.regexp_replace(out, COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), GAPS, " ")
    for old, new in EQUIVALENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def canonical_text(text: str | None) -> str:
    """The same in Python, for the known texts."""
    text = (text or "").lower().replace("\r", "\n")
    text = re.sub(COPYRIGHT_LINE, r"\1", text)
    text = re.sub(r"[\W_]+", " ", text.replace("&", " and "))
    for old, new in EQUIVALENTS:
        text = text.replace(old, new)
    return text.strip()


def known_digests(known: dict[str, list[str]] = KNOWN_LICENSES) -> dict[str, str]:
    """Digest to licence; a text listed under two licences belongs to the first in order of names."""
    out: dict[str, str] = dict(KNOWN_DIGESTS) if known is KNOWN_LICENSES else {}
    for name in sorted(known):
        for text in known[name]:
            out.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), name)
    return out


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, list[str]] = KNOWN_LICENSES
) -> DataFrame:
    """One row per document: id, ``canonical_sha256``, ``canonical_chars``, ``license_id`` (null: not a known licence text), ``matched``.

    The digest is of the whole canonical text, so a document matches when all of it is a known
    licence, however it is wrapped; a licence inside a longer text is none. The known digests are a
    fixed list in the program (a few dozen rows), which bounds the broadcast; the documents are not
    shuffled. Null and empty texts have an empty canonical text and match nothing, texts may be of any
    length, and repeated rows give repeated rows. An empty table gives no rows; other columns are not
    read.
    """
    spark = docs.sparkSession
    lookup = spark.createDataFrame(sorted(known_digests(known).items()), "canonical_sha256 string, license_id string")
    return (
        docs.select(F.col(id_col), canonical(docs[text_col]).alias("_c"))
        .select(id_col, F.sha2("_c", 256).alias("canonical_sha256"), F.length("_c").cast("long").alias("canonical_chars"))
        .join(F.broadcast(lookup), "canonical_sha256", "left")
        .select(id_col, "canonical_sha256", "canonical_chars", "license_id", F.col("license_id").isNotNull().alias("matched"))
    )


def oracle() -> str:
    text = "regexp_replace(translate(lower(coalesce(text, '')), chr(13), chr(10)), '%s', '\\1', 'g')" % COPYRIGHT_LINE
    text = f"regexp_replace(replace({text}, '&', ' and '), '{GAPS}', ' ', 'g')"
    for old, new in EQUIVALENTS:
        text = f"replace({text}, '{old}', '{new}')"
    text = f"trim({text})"
    rows = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests().items()))
    return f"""
        WITH c AS (SELECT doc_id, {text} AS c FROM documents),
             known(digest, license_id) AS (VALUES {rows})
        SELECT doc_id, sha256(c) AS canonical_sha256, length(c) AS canonical_chars, license_id, license_id IS NOT NULL AS matched
        FROM c LEFT JOIN known ON digest = sha256(c)"""
