"""The thin queries ``opN_<name>`` over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import bpe, fingerprints, html, licenses, neighbours, packing, quality, simhash, substrings, warc
from lexigrain.llm.common import scratch_path, small_batches

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))
    # fewer files than shuffle partitions: Hadoop's local file system starts a process for each file and folder that a task makes
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.coalesce(max(4 * spark.sparkContext.defaultParallelism, partitions // 8))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_text(F.col("sig")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        fingerprints.likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licenses"),
        F.size("licences").cast("long").alias("n_licenses"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.tokenise_and_pack(_table(spark, sf_dir, "documents"), WORD_BPE)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.repeated_passages(_table(spark, sf_dir, "documents"))
    return rows.select(
        "row.doc_id",
        F.col("kept_text").alias("text"),
        F.length("kept_text").cast("long").alias("n_chars"),
        (F.length(F.coalesce("row.text", F.lit(""))) - F.length("kept_text")).cast("long").alias("n_removed"),
        "spans",
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    rows = quality.score(docs, model)
    return rows.select(
        "doc_id",
        quality.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), BYTE_BPE), BYTE_BPE)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    rows = warc.parse_records(warc.read_archive(spark, path))
    return warc.checked(rows).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.extract_pages(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_simhash": op2_simhash,
    "op3_licenses": op3_licenses,
    "op4_packing": op4_packing,
    "op5_substrings": op5_substrings,
    "op6_quality": op6_quality,
    "op7_neighbours": op7_neighbours,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_html": op10_html,
}

# DuckDB has neither XXH64 with a seed, nor the tokenizers, models or HTML parsing;
# those operators are tested against brute force, round trips and held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op3_licenses": """
        WITH notice(sentence, sid, name) AS (VALUES
            ('This work is licensed under the GNU General Public License, version 3.', 'gpl-3-notice', 'GPL-3.0'),
            ('Licensed under CC BY-NC 4.0.', 'cc-by-nc-4-notice', 'CC-BY-NC-4.0'),
            ('Released under the MIT License.', 'mit-notice', 'MIT'),
            ('Licensed under the Apache License, Version 2.0.', 'apache-2-notice', 'Apache-2.0')),
        line AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k
            FROM documents),
        hit AS (SELECT doc_id, k, sid, name FROM line JOIN notice ON trim(line) = sentence)
        SELECT d.doc_id,
               coalesce(string_agg(sid, ',' ORDER BY k), '') AS sentence_ids,
               coalesce(string_agg(name, ',' ORDER BY k) FILTER (WHERE first), '') AS licenses,
               count(*) FILTER (WHERE first) AS n_licenses
        FROM documents d LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY k) = 1 AS first FROM hit
        ) USING (doc_id)
        GROUP BY d.doc_id
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, strlen(body) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + cast(('0x' || substring(hex, 1 + 5 * (i // 4), 5))::BIGINT // [32768, 1024, 32, 1][1 + i % 4] % 32 AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM q
    """,
}
