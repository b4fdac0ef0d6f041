"""Masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.masks import decrypt_value
from ...operators.redact import (
    Policy, audit_log, config_policy, explode_items, policy_table, redact, redact_by_table,
    restore, span_replacements,
)
from ...operators.resolve import resolve
from ...operators.scan import explode_spans, scan
from ...plans.text import process, result_record
from ...sources.writers import as_json
from . import sqltext as q
from .detection import RAW, all_checked, strict
from .inputs import AS_OF, documents
from .registry import query

COVERED = [*all_checked(), q.covered("v", "d")]
OUT = ["doc_id", "n_entities", "redacted_text"]


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with settled spans of all rules."""
    return resolve(scan(documents(spark, sf_dir), strict()), "cover")


def _redacted(spark: SparkSession, sf_dir: str, policy: list[Policy]) -> DataFrame:
    masked = redact(found(spark, sf_dir), policy)
    return masked.select("doc_id", F.size("spans").cast("long").alias("n_entities"), "redacted_text")


def _redact_sql(replacement: str) -> str:
    return q.with_query(
        [*COVERED, q.masked("m", "v", "documents", replacement)],
        "SELECT doc_id, n_entities, redacted_text FROM m",
    )


@query("redact_replace", _redact_sql("'[REDACTED]'"))
def redact_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir, [Policy()])


@query("redact_placeholder", _redact_sql("'<' || entity_type || '>'"))
def redact_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir, [])


MASK_SQL = (
    "substring(value, 1, length(value) - least(6, length(value))) "
    "|| repeat('#', CAST(least(6, length(value)) AS INTEGER))"
)


@query("redact_mask", _redact_sql(MASK_SQL))
def redact_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(
        spark, sf_dir, [Policy(operator="mask", masking_char="#", chars_to_mask=6, from_end=True)]
    )


@query("redact_mask_all", _redact_sql("repeat('*', CAST(length(value) AS INTEGER))"))
def redact_mask_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir, [Policy(operator="mask")])


@query("redact_hash", _redact_sql("sha256(value)"))
def redact_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir, [Policy(operator="hash")])


@query("redact_hash_md5_salted", _redact_sql("md5('pepper' || value)"))
def redact_hash_md5_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir, [Policy(operator="hash", hash_type="md5", salt="pepper")])


@query("redact_remove", _redact_sql("''"))
def redact_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir, [Policy(operator="redact")])


POLICY_SQL = """CASE entity_type
  WHEN 'PERSON' THEN '[PERSON]' WHEN 'EMAIL_ADDRESS' THEN '[EMAIL]' WHEN 'URL' THEN '[URL]'
  WHEN 'PHONE_NUMBER' THEN substring(value, 1, length(value) - least(7, length(value)))
    || repeat('*', CAST(least(7, length(value)) AS INTEGER))
  WHEN 'ID_CARD' THEN repeat('*', CAST(least(12, length(value)) AS INTEGER)) || substring(value, 13)
  WHEN 'BANK_CARD' THEN repeat('*', CAST(least(12, length(value)) AS INTEGER)) || substring(value, 13)
  ELSE '<' || entity_type || '>' END"""
POLICY_OPERATOR_SQL = (
    "CASE WHEN entity_type IN ('PHONE_NUMBER', 'ID_CARD', 'BANK_CARD') THEN 'mask' ELSE 'replace' END"
)


@query("redact_by_policy", _redact_sql(POLICY_SQL))
def redact_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy comes as a table."""
    masked = redact_by_table(found(spark, sf_dir), policy_table(spark, config_policy()))
    return masked.select("doc_id", F.size("spans").cast("long").alias("n_entities"), "redacted_text")


@query("policy_join", q.with_query(
    COVERED, f'SELECT doc_id, "start", "end", entity_type, {POLICY_SQL} AS replacement, '
    f"{POLICY_OPERATOR_SQL} AS operator FROM v"))
def policy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span by span, as a join to the policy table."""
    spans = explode_spans(found(spark, sf_dir), "doc_id")
    named = span_replacements(spans, policy_table(spark, config_policy()), ["doc_id"])
    return named.select("doc_id", "start", "end", "entity_type", "replacement", "operator")


DEFAULT_SQL = """CASE entity_type WHEN 'URL' THEN '[URL]' WHEN 'EMAIL_ADDRESS' THEN sha256(value) ELSE '[X]' END"""
DEFAULT_POLICY = [
    Policy("URL", new_value="[URL]"), Policy("EMAIL_ADDRESS", operator="hash"), Policy(new_value="[X]"),
]


@query("redact_default_small", _redact_sql(DEFAULT_SQL))
def redact_default_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a row for all other types, small enough to become an expression."""
    masked = redact_by_table(found(spark, sf_dir), policy_table(spark, DEFAULT_POLICY))
    return masked.select("doc_id", F.size("spans").cast("long").alias("n_entities"), "redacted_text")


@query("redact_default_large", q.with_query(
    [*COVERED, q.masked("m", "v", "documents", DEFAULT_SQL)],
    "SELECT CASE WHEN doc_id % 5 > 0 THEN doc_id // 3 END AS doc_id, n_entities, redacted_text FROM m"))
def redact_default_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table, taken as a large one; keys are null or stand for several texts."""
    keyed = found(spark, sf_dir).withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.expr("doc_id div 3")))
    masked = redact_by_table(keyed, policy_table(spark, DEFAULT_POLICY), max_rows=1)
    return masked.select("doc_id", F.size("spans").cast("long").alias("n_entities"), "redacted_text")


@query("redact_restore", q.with_query(
    COVERED, """SELECT d.doc_id, count(v.doc_id) AS n_entities, any_value(d.text) AS restored_text,
      CAST(NULL AS VARCHAR) AS restore_error, count(v.doc_id) > 0 AS refused
    FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY d.doc_id"""))
def redact_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with encrypted values, restored by the item log; another key is refused wherever there is a value."""
    key = "0123456789abcdef"
    masked = redact(found(spark, sf_dir), [Policy(operator="encrypt", key=key)])
    back = restore(masked, key).withColumnsRenamed({"restored_text": "back", "restore_error": "back_error"})
    tried = restore(back, "fedcba9876543210")
    return tried.select(
        "doc_id", F.size("items").cast("long").alias("n_entities"), F.col("back").alias("restored_text"),
        F.col("back_error").alias("restore_error"),
        (F.col("restore_error").isNotNull() & F.col("restored_text").isNull()).alias("refused"),
    )


@query("redact_custom", _redact_sql("upper(substring(value, 1, 2)) || '..'"))
def redact_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep_head = Policy(
        operator="custom",
        function=lambda v: F.concat(F.upper(F.substring(v, 1, 2)), F.lit("..")),
    )
    return _redacted(spark, sf_dir, [keep_head])


@query("redact_encrypt_roundtrip", q.with_query(
    COVERED, 'SELECT doc_id, entity_type, "start", "end", value AS decrypted FROM v'))
def redact_encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted values, decrypted again: what the mask hid comes back."""
    key = "0123456789abcdef"
    masked = redact(found(spark, sf_dir), [Policy(operator="encrypt", key=key)])
    edits = masked.select("doc_id", F.inline(F.filter("edits", lambda e: e.isNotNull())))
    return edits.select(
        "doc_id", "entity_type", "start", "end",
        decrypt_value(F.col("replacement"), key).alias("decrypted"),
    )


ITEMS = [*COVERED, q.items("i", "v", POLICY_SQL, POLICY_OPERATOR_SQL)]


@query("redaction_items", q.with_query(
    ITEMS, 'SELECT doc_id, "start", "end", entity_type, text, operator FROM i'))
def redaction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = redact(found(spark, sf_dir), config_policy())
    return explode_items(masked, "doc_id").drop("score")


@query("audit_log", q.with_query(
    ITEMS, 'SELECT doc_id, "start", "end", entity_type, operator FROM i'))
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_log(redact(found(spark, sf_dir), config_policy()), "doc_id")


@query("result_json", q.with_query(
    [*COVERED, q.masked("m", "v", "documents", POLICY_SQL),
     q.items("i", "v", POLICY_SQL, POLICY_OPERATOR_SQL),
     """spans_json AS (SELECT doc_id, list(struct_pack(entity_type := entity_type, "start" := "start",
       "end" := "end", score := score) ORDER BY "start") AS analysis_results FROM v GROUP BY doc_id)""",
     """items_json AS (SELECT i.doc_id, list(struct_pack("start" := i."start", "end" := i."end",
       entity_type := i.entity_type, text := i.text, operator := i.operator, score := CAST(1.0 AS DOUBLE))
       ORDER BY i."start") AS items FROM i GROUP BY i.doc_id)"""],
    """SELECT m.doc_id, json_extract_string(j, '$.anonymized_text') AS anonymized_text,
      CAST(json_extract(j, '$.metadata.total_segments') AS BIGINT) AS total_segments,
      CAST(json_extract(j, '$.metadata.total_entities') AS BIGINT) AS total_entities,
      json_extract_string(j, '$.analysis_results[0].entity_type') AS first_type,
      coalesce(CAST(json_array_length(j, '$.items') AS BIGINT), 0) AS n_items
    FROM (SELECT m.doc_id, to_json(struct_pack(anonymized_text := m.redacted_text,
        analysis_results := coalesce(s.analysis_results, []), items := coalesce(i.items, []),
        metadata := struct_pack(
          total_segments := CASE WHEN regexp_matches(m.text, '\\S') THEN 1 ELSE 0 END,
          total_entities := m.n_entities))) AS j
      FROM m LEFT JOIN spans_json s ON s.doc_id = m.doc_id
      LEFT JOIN items_json i ON i.doc_id = m.doc_id) m"""))
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested result as JSON, read back: what the sink would hold."""
    done = process(documents(spark, sf_dir), config_policy(), rules=strict())
    record = as_json(result_record(done))
    path = lambda p: F.get_json_object("result", p)
    return record.select(
        "doc_id",
        path("$.anonymized_text").alias("anonymized_text"),
        path("$.metadata.total_segments").cast("long").alias("total_segments"),
        path("$.metadata.total_entities").cast("long").alias("total_entities"),
        path("$.analysis_results[0].entity_type").alias("first_type"),
        F.coalesce(F.json_array_length(path("$.items")), F.lit(0)).cast("long").alias("n_items"),
    )


__all__ = ["AS_OF", "COVERED", "RAW", "found"]
