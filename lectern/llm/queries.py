"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, dedup, jaccard, licenses, quality, secrets_scan, toxicity, warc
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secret_scan(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))["documents"].select("doc_id", "class_id", "n_links")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scans, op2_jaccard_join, op3_exact_dedup, op4_byte_bpe, op5_toxicity, op6_warc, op7_decontamination,
        op8_chat_perspectives, op9_quality, op10_license_scan, pipeline,
    )
}

_OP2 = r"""
    WITH RECURSIVE
    words AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[\x{80}-\x{a9}\x{ab}-\x{b4}\x{b6}-\x{b9}\x{bb}-\x{bf}\x{d7}\x{f7}\x{2000}-\x{206f}\x{3000}-\x{303f}\x{feff}]', ' ', 'g'), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM documents),
    grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    links AS (
        SELECT a.doc_id AS a, b.doc_id AS b
        FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
        JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id
        HAVING count(*) >= 0.8 * (any_value(x.n) + any_value(y.n) - count(*)) - 1e-9),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT d.doc_id, least(d.doc_id, coalesce(m.root, d.doc_id)) AS class_id, coalesce(c.n, 0) AS n_links
    FROM documents d
    LEFT JOIN (SELECT a, min(b) AS root FROM reach GROUP BY a) m ON m.a = d.doc_id
    LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = d.doc_id"""

_OP3 = r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
         g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""

_OP6 = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
         s AS (SELECT page_id, octet_length(h) AS bytes, sha1(h) AS digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
    SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
           CASE WHEN bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN bytes >= 1000 AND page_id <> top THEN top END AS refers_to
    FROM s"""

_OP8 = r"""
    WITH t AS (
        SELECT conv_id, floor(coalesce(turn, 0) / 16384)::BIGINT AS part, turn, coalesce(nullif(trim(role), ''), 'unknown') AS who,
               replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS text,
               replace(replace(regexp_replace(who, '[\r\n]+', ' ', 'g'), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS shown
        FROM conversations),
    w AS (SELECT DISTINCT conv_id, who AS participant FROM t WHERE who <> 'system'),
    s AS (
        SELECT t.conv_id, w.participant, part, turn, who, shown, text, who = participant AS mine,
               CASE WHEN who = participant THEN '<|im_start|>assistant' || chr(10)
                    WHEN who = 'system' THEN '<|im_start|>system' || chr(10)
                    ELSE '<|im_start|>user name=' || shown || chr(10) END AS head
        FROM t JOIN w ON t.conv_id = w.conv_id),
    l AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS seg FROM s),
    o AS (SELECT *, coalesce(sum(length(seg)) OVER (PARTITION BY conv_id, participant, part ORDER BY turn, who, text
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l)
    SELECT conv_id, participant, part, string_agg(seg, '' ORDER BY turn, who, text) AS rendered, count(*) AS n_turns,
           count(*) FILTER (mine) AS n_own,
           coalesce(string_agg((pos + length(head))::BIGINT::VARCHAR || ':' || (pos + length(seg) - 1)::BIGINT::VARCHAR, ',' ORDER BY turn, who, text) FILTER (mine), '') AS mask,
           coalesce(sum(length(seg) - 1 - length(head)) FILTER (mine), 0)::BIGINT AS mask_chars
    FROM o GROUP BY conv_id, participant, part"""

ORACLES = {
    "op2_jaccard_join": _OP2,
    "op3_exact_dedup": _OP3,
    "op6_warc": _OP6,
    "op7_decontamination": decontam.oracle(),
    "op8_chat_perspectives": _OP8,
    "op10_license_scan": licenses.oracle(),
}
