"""Counts, summaries and quality figures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def entity_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy("entity_type")


def entity_summary(spans: DataFrame) -> DataFrame:
    """Counts by type and a ``total`` row."""
    return (
        spans.rollup("entity_type")
        .agg(F.count("*").alias("n"), F.grouping("entity_type").alias("g"))
        .select(F.when(F.col("g") == 1, "total").otherwise(F.col("entity_type")).alias("entity_type"), "n")
    )


def totals(df: DataFrame, segments_col: str = "segments", spans_col: str = "spans") -> DataFrame:
    """Per text: ``total_segments`` and ``total_entities``."""
    return df.withColumn("total_segments", F.size(segments_col)).withColumn(
        "total_entities", F.size(spans_col)
    )


def length_report(df: DataFrame) -> DataFrame:
    """Characters before and after masking, and segments, over all texts."""
    return df.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum(F.length("redacted_text")), F.lit(0)).alias("chars_after"),
        F.coalesce(F.sum(F.size("segments")), F.lit(0)).alias("n_segments"),
    )


def confidence_report(spans: DataFrame, *keys: str) -> DataFrame:
    """Number of spans and their mean score, 0.0 when there are none."""
    return spans.groupBy(*keys).agg(
        F.count("*").alias("pii_count"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_confidence")
    )


def transcript_report(segments: DataFrame, *keys: str, n_chars: Column | None = None) -> DataFrame:
    """Per recording: duration, segments, characters and language.

    ``n_chars`` is the number of characters of a segment where the texts are not at hand.
    """
    return segments.groupBy(*keys).agg(
        F.sum(F.col("end_time") - F.col("start_time")).alias("total_duration"),
        F.count("*").alias("n_segments"),
        F.sum(F.length("text") if n_chars is None else n_chars).alias("n_chars"),
        F.coalesce(F.max("language"), F.lit("unknown")).alias("language"),
    )


def precision_recall(predicted: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Exact-match precision, recall and F1 by type, and ``overall``."""
    on = [key, "entity_type", "start", "end"]
    marks = predicted.select(*on, F.lit(True).alias("in_pred"), F.lit(False).alias("in_gold")).unionByName(
        gold.select(*on, F.lit(False).alias("in_pred"), F.lit(True).alias("in_gold"))
    )
    return precision_recall_of(marks, key)


def precision_recall_of(marks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same from one table of spans marked ``in_pred`` and ``in_gold``; a span may have several rows."""
    spans = marks.groupBy(key, "entity_type", "start", "end").agg(
        F.bool_or("in_pred").alias("in_pred"), F.bool_or("in_gold").alias("in_gold")
    )
    said, true = F.col("in_pred"), F.col("in_gold")
    counted = spans.rollup("entity_type").agg(
        F.grouping("entity_type").alias("g"),
        F.count_if(said & true).alias("tp"),
        F.count_if(said & ~true).alias("fp"),
        F.count_if(true & ~said).alias("fn"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(
        F.when(F.col("g") == 1, "overall").otherwise(F.col("entity_type")).alias("entity_type"),
        "tp", "fp", "fn",
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def error_rate(df: DataFrame, *stage: str) -> DataFrame:
    """Share of rows with an error, by stage."""
    return df.groupBy(*stage).agg(
        F.count("*").alias("n"), F.avg(F.col("error").isNotNull().cast("int")).alias("error_rate")
    )


def observed(masked: DataFrame, entities: Iterable[str], name: str = "masking") -> tuple[DataFrame, Observation]:
    """``masked`` as it is, with its figures gathered by the next action on it: no second scan.

    The observation holds ``rows``, ``errors``, ``spans`` and, for each of ``entities``, the number
    of its spans as ``n_<entity>``. Figures of a task count when it ends well, once for a
    partition of the action's last stage: tasks that fail and run again, or run twice, add
    nothing. Where a shuffle follows, a lost executor's tasks run again and are counted again,
    so figures belong on the row-by-row write of masked texts.
    """
    observation = Observation(name)
    spans = F.coalesce(F.col("spans"), F.array().cast(masked.schema["spans"].dataType))

    def number(entity: str) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(spans, lambda s: s.getField("entity_type") == entity))), F.lit(0))

    figures = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.coalesce(F.sum(F.size(spans)), F.lit(0)).alias("spans"),
        *[number(e).alias(f"n_{e}") for e in entities],
    ]
    return masked.observe(observation, *figures), observation
