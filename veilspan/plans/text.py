"""From texts to masked texts in one narrow pass."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.redact import Policy, redact
from ..operators.resolve import resolve
from ..operators.rules import DEFAULT_THRESHOLD, Rule, builtin_rules, select_rules
from ..operators.scan import boost_expr, keep_expr, rule_context, scan, scan_expr
from ..operators.segment import scan_segments, segment


def analyze(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    entities: Iterable[str] | None = None,
    denied: Iterable[str] = (),
    disabled: Iterable[str] = (),
    languages: Iterable[str] | None = None,
    threshold: float | None = DEFAULT_THRESHOLD,
    context_window: int | None = None,
    context_boost: float = 0.35,
    overlap: str = "cover",
    segment_by: str | None = None,
    text_col: str = "text",
) -> DataFrame:
    """Add settled ``spans``.

    Rules whose hits would be dropped are left out before the scan. With
    ``context_window`` characters, words of a rule's context before a hit raise its
    score. With ``segment_by`` the rules see one segment at a time and ``segments``
    is added too.
    """
    chosen = select_rules(
        builtin_rules() if rules is None else rules, entities, denied, languages, disabled
    )
    if segment_by:
        df = segment(df, segment_by, text_col, post_process=False)
        df = scan_segments(df, chosen)
    else:
        df = scan(df, chosen, text_col)
    spans = F.col("spans")
    if context_window is not None:
        spans = boost_expr(
            spans, F.col(text_col), rule_context(chosen), context_window, context_boost
        )
    df = df.withColumn("spans", keep_expr(spans, threshold))
    return resolve(df, overlap, text_col=text_col)


def anonymize(df: DataFrame, policy: Iterable[Policy] = (), text_col: str = "text") -> DataFrame:
    """Mask what is in ``spans``."""
    return redact(df, policy, text_col)


def process(
    df: DataFrame, policy: Iterable[Policy] = (), text_col: str = "text", **options
) -> DataFrame:
    """Find and mask. Keeps every row; blank texts come out as they are."""
    if options.get("overlap", "cover") == "none":
        raise ValueError("masking needs settled spans")
    found = analyze(df, text_col=text_col, **options)
    if "segments" not in found.columns:
        found = found.withColumn(
            "segments", F.when(is_blank(F.col(text_col)), F.array()).otherwise(F.array(F.lit(0)))
        )
    return (
        anonymize(found, policy, text_col)
        .withColumn("total_segments", F.coalesce(F.size("segments"), F.lit(0)))
        .withColumn("total_entities", F.size("spans"))
        .drop("segments")
    )


def result_record(processed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One nested row per text: masked text, spans without their values, items, totals."""
    return processed.select(
        key,
        F.col("redacted_text").alias("anonymized_text"),
        F.transform(
            "spans",
            lambda s: F.struct(*[s.getField(n).alias(n) for n in ("entity_type", "start", "end", "score")]),
        ).alias("analysis_results"),
        F.col("items"),
        F.struct("total_segments", "total_entities", "error").alias("metadata"),
    )


__all__ = ["analyze", "anonymize", "process", "result_record", "scan_expr"]
