"""Registered queries of the corpus operators, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import literal_rows, table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.mixing import mixed

    rows = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).withColumn("target", F.round("target", 6))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.license_scan import document_licenses

    return document_licenses(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.quality import judged

    rows = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("row.doc_id", F.round("p_reject", 6).alias("p_reject"), F.round("p_weak", 6).alias("p_weak"), "keep")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.decontaminate import decontamination_report

    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.winnow import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


def op7_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.span_dedup import span_report

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return span_report(docs).select("row.*", "n_sentences", "n_removed")


def op8_warc_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.warc import archived

    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.chat_format import PROBE, digests, formatted

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = literal_rows(spark, PROBE, "conv_id bigint, turn bigint, role string, text string")
    return digests(formatted(turns.unionByName(probe)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_html_extraction": op2_html_extraction,
    "op3_license_scan": op3_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_winnowing": op6_winnowing,
    "op7_sentence_span_dedup": op7_sentence_span_dedup,
    "op8_warc_converter": op8_warc_converter,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_chat_formatting": op10_chat_formatting,
}

_OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, substr(md5('mix-1:' || doc_id), 1, 3) AS bucket,
         len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
per_source AS (
  SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][(rnk % 3 + 1)::INT]::DOUBLE AS w, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS amount FROM per_source),
levels AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_w
  FROM weighted WINDOW o AS (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT arg_min((amount - capped) / open_w, struct_pack(r := cap / w, k := rnk)) FILTER (WHERE (amount - capped) / open_w * w <= cap) AS l FROM levels),
targets AS (SELECT source, source_size, least(cap, w * l) AS target FROM weighted, lvl),
plan AS (SELECT *, floor(target / source_size) AS whole, target - floor(target / source_size) * source_size AS rest FROM targets),
buckets AS (
  SELECT source, bucket, sum(size) AS bsize, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized GROUP BY source, bucket)
SELECT d.doc_id, d.size, p.source_size::BIGINT AS source_size, round(p.target, 6) AS target,
       (d.size * p.whole + CASE WHEN b.before + b.bsize <= p.rest THEN d.size
                                WHEN b.before < p.rest THEN round(d.size * ((p.rest - b.before) / b.bsize)) ELSE 0 END)::BIGINT AS taken
FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
JOIN buckets b ON b.source IS NOT DISTINCT FROM d.source AND b.bucket = d.bucket
"""

_OP10 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
per AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(replace(replace(replace(role || text, '\', '\a'), '<', '\b'), '[', '\c')) + 6 + 7 + 6) + 3 + 4 AS formatted_chars,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS path
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, regexp_full_match(path, 's?u(au)*a?') AS valid
FROM per
"""

ORACLE_SQL: dict[str, str] = {"op1_source_mixing": _OP1, "op10_chat_formatting": _OP10}
