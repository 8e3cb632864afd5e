"""Queries of the problems of language-model training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import encode, fingerprints, leaks, names, personal, stuffing
from cellwright.session import table


def _parties(spark: SparkSession, d: str) -> DataFrame:
    dupes, invoices = table(spark, d, "dupes"), table(spark, d, "invoices")
    return names.party_of([dupes.select("name"), invoices.select("vendor")], dupes.select("city"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(_parties(spark, d))


def p2_parties(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with its party."""
    return _parties(spark, d)


def _personal(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_spans(personal.texts_of(table(spark, d, "ir_elements"), table(spark, d, "feedback_records")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("origin", "record_id", F.inline("found")).distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("origin", "record_id", "redacted")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = fingerprints.format_duplicates(table(spark, d, "dupes"), "dupe_id", [["name", "city"]], "name")
    return found.select("first_id", "dupe_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 12 words of an item within 15 places, up to 3 of them replaced."""
    return leaks.proximity_matches(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_documents(table(spark, d, "documents")).filter("is_spam").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_parties, p4_found, p4_redacted, p6_found, p7_ids, p8_found, p8_near, p9_found)}
ORACLES = {
    "p6_found": r"""
        WITH k AS (SELECT dupe_id, regexp_replace(lower(name), '[^\p{L}\p{N}]+', '', 'g') AS a,
                          coalesce(regexp_replace(lower(city), '[^\p{L}\p{N}]+', '', 'g'), '') AS b
                   FROM dupes WHERE name IS NOT NULL),
        g AS (SELECT dupe_id, min(dupe_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS first_id FROM k WHERE a <> '')
        SELECT first_id, dupe_id FROM g WHERE dupe_id <> first_id""",
    "p8_found": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
        ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
