"""Counts, lengths, quality against a gold standard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import metrics
from ...operators.redact import config_policy, redact
from ...operators.resolve import resolve
from ...operators.scan import entity_list, explode_spans, language_or_default, scan
from ...operators.segment import segment
from ...operators.steps import new_path
from ...sources.readers import read_table
from . import sqltext as q
from .detection import RAW, all_checked, strict
from .inputs import documents
from .redaction import COVERED, POLICY_SQL, found
from .registry import query
from .segments import SENTENCES_SQL, finished


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_spans(found(spark, sf_dir), "doc_id")


@query("entity_counts", q.with_query(
    COVERED, "SELECT entity_type, count(*) AS n FROM v GROUP BY entity_type"))
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.entity_counts(_spans(spark, sf_dir))


@query("entity_summary_rollup", q.with_query(
    COVERED, "SELECT CASE WHEN grouping(entity_type) = 1 THEN 'total' ELSE entity_type END "
    "AS entity_type, count(*) AS n FROM v GROUP BY ROLLUP (entity_type)"))
def entity_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.entity_summary(_spans(spark, sf_dir))


@query("entities_by_source", q.with_query(
    COVERED, "SELECT source, entity_type, count(*) AS n FROM v JOIN documents USING (doc_id) "
    "GROUP BY source, entity_type"))
def entities_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = explode_spans(
        resolve(scan(documents(spark, sf_dir, "source"), strict()), "cover"), "source"
    )
    return spans.groupBy("source", "entity_type").agg(F.count("*").alias("n"))


@query("doc_totals", q.with_query(
    [*COVERED, "n AS (SELECT doc_id, count(*) AS n FROM v GROUP BY doc_id)",
     SENTENCES_SQL, finished("s", "placed"),
     "k AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id)"],
    """SELECT d.doc_id, CAST(coalesce(k.k, 0) AS INTEGER) AS total_segments,
      CAST(coalesce(n.n, 0) AS INTEGER) AS total_entities
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""))
def doc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segment(found(spark, sf_dir), "sentence")
    return metrics.totals(cut).select("doc_id", "total_segments", "total_entities")


@query("doc_lengths", q.with_query(
    [*COVERED, q.masked("m", "v", "documents", POLICY_SQL), SENTENCES_SQL, finished("s", "placed")],
    """SELECT count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS chars_before,
      CAST(sum(length(redacted_text)) AS BIGINT) AS chars_after,
      (SELECT count(*) FROM s) AS n_segments FROM m"""))
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = redact(found(spark, sf_dir), config_policy())
    return metrics.length_report(segment(masked, "sentence"))


@query("pii_confidence", q.with_query(
    [q.hits("h", "documents", RAW)],
    "SELECT entity_type, count(*) AS pii_count, round(avg(score), 6) AS mean_confidence "
    "FROM h GROUP BY entity_type"))
def pii_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = explode_spans(scan(documents(spark, sf_dir), RAW), "doc_id")
    report = metrics.confidence_report(spans, "entity_type")
    return report.withColumn("mean_confidence", F.round("mean_confidence", 6))


GOLD_SQL = """
gold AS (SELECT DISTINCT doc_id, CASE WHEN ("start" + doc_id) % 11 = 0 THEN 'OTHER' ELSE entity_type END
  AS entity_type, "start", "end" FROM d WHERE ("start" + doc_id) % 10 <> 0),
pred AS (SELECT doc_id, entity_type, "start", "end" FROM d),
pairs AS (SELECT coalesce(p.entity_type, g.entity_type) AS entity_type,
    p.doc_id IS NOT NULL AS said, g.doc_id IS NOT NULL AS holds
  FROM pred p FULL JOIN gold g ON p.doc_id = g.doc_id AND p.entity_type = g.entity_type
    AND p."start" = g."start" AND p."end" = g."end"),
counted AS (SELECT CASE WHEN grouping(entity_type) = 1 THEN 'overall' ELSE entity_type END AS entity_type,
    count(*) FILTER (said AND holds) AS tp, count(*) FILTER (said AND NOT holds) AS fp,
    count(*) FILTER (holds AND NOT said) AS fn
  FROM pairs GROUP BY ROLLUP (entity_type))"""


@query("eval_prf", q.with_query(
    [*all_checked(), GOLD_SQL],
    """SELECT entity_type, tp, fp, fn,
      round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS "precision",
      round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1
    FROM counted"""))
def eval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a gold standard with every tenth span missing and every eleventh of another type."""
    predicted = explode_spans(resolve(scan(documents(spark, sf_dir), strict()), "none"), "doc_id")
    mark = F.col("start") + F.col("doc_id")
    # Both sides of a span come out of one pass over the texts.
    gold_type = F.when(mark % 11 == 0, "OTHER").otherwise(F.col("entity_type"))
    sides = F.array(
        F.struct(F.col("entity_type").alias("entity_type"), F.lit(True).alias("in_pred"), F.lit(False).alias("in_gold")),
        F.when(
            mark % 10 != 0,
            F.struct(gold_type.alias("entity_type"), F.lit(False).alias("in_pred"), F.lit(True).alias("in_gold")),
        ),
    )
    marks = predicted.select("doc_id", "start", "end", F.inline(F.array_compact(sides)))
    report = metrics.precision_recall_of(marks)
    return report.select(
        "entity_type", "tp", "fp", "fn",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
    )


@query("language_default", """
SELECT CASE WHEN lang = 'es' OR lang IS NULL THEN 'zh' ELSE lang END AS language, count(*) AS n
FROM documents GROUP BY 1""")
def language_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish texts say ``auto`` and get the default."""
    lang = F.when(F.col("lang") == "es", "auto").otherwise(F.col("lang"))
    return (
        read_table(spark, f"{sf_dir}/documents.parquet", "lang")
        .select(language_or_default(lang).alias("language"))
        .groupBy("language")
        .agg(F.count("*").alias("n"))
    )


@query("entity_csv", """
SELECT o_orderkey, name FROM (SELECT o_orderkey, trim(UNNEST(string_split(
  o_orderpriority || ' , ,' || o_orderstatus || ',', ','))) AS name FROM orders) WHERE name <> ''""")
def entity_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated names as a list, with blanks and empty fields on the way."""
    csv = F.concat("o_orderpriority", F.lit(" , ,"), "o_orderstatus", F.lit(","))
    orders = read_table(
        spark, f"{sf_dir}/orders.parquet", "o_orderkey", "o_orderpriority", "o_orderstatus"
    )
    return orders.select("o_orderkey", F.explode(entity_list(csv)).alias("name"))


OBSERVED = ["BANK_CARD", "EMAIL_ADDRESS", "IP_ADDRESS", "PHONE_NUMBER", "URL"]


@query("masking_observed", q.with_query(
    COVERED,
    f"""SELECT 'rows' AS figure, count(*) AS n FROM documents UNION ALL SELECT 'errors', 0
    UNION ALL SELECT 'spans', count(*) FROM v UNION ALL
    SELECT 'n_' || t, (SELECT count(*) FROM v WHERE entity_type = t) FROM (SELECT UNNEST({OBSERVED}) AS t)"""))
def masking_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a masking run, gathered while its result is written."""
    masked, figures = metrics.observed(redact(found(spark, sf_dir), config_policy()), OBSERVED)
    masked.select("doc_id", "redacted_text", "error").write.parquet(new_path(spark, "observed"))
    return spark.createDataFrame(list(figures.get.items()), "figure string, n long")
