"""Scan texts with rules. Spans stay an array on the text's own row: no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import empty_array, let, literal_array
from ..functions.text import contains_any, find_matches, slice_text
from .rules import DEFAULT_LANGUAGE, DEFAULT_THRESHOLD, Rule

SPAN_TYPE = (
    "struct<entity_type:string,start:int,end:int,score:double,"
    "recognizer:string,pattern:string,pattern_score:double,value:string>"
)
SPAN_FIELDS = [
    "entity_type", "start", "end", "score", "recognizer", "pattern", "pattern_score", "value",
]


def span_struct(**fields: Column) -> Column:
    """A span with its fields in the one order used everywhere."""
    return F.struct(*[fields[name].alias(name) for name in SPAN_FIELDS])


def with_fields(span: Column, **changes: Column) -> Column:
    return span_struct(**{n: changes.get(n, span.getField(n)) for n in SPAN_FIELDS})


def scan_expr(text: Column, rules: Sequence[Rule]) -> Column:
    """All spans of all rules in one text, as one array expression."""
    if not rules:
        return empty_array(SPAN_TYPE)
    guard_regexes = list(dict.fromkeys(r.trigger_regex for r in rules if r.trigger_regex))
    guard_strings = list(dict.fromkeys(r.trigger for r in rules if r.trigger))
    # Rules that share a guard test it once between them.
    flags = F.array(
        *[F.contains(text, F.lit(g)) for g in guard_strings],
        *[text.rlike(g) for g in guard_regexes],
    )

    def guard(rule: Rule, flag: Column) -> Column | None:
        on = None
        if rule.trigger:
            on = flag[guard_strings.index(rule.trigger)]
        if rule.trigger_regex:
            more = flag[len(guard_strings) + guard_regexes.index(rule.trigger_regex)]
            on = more if on is None else on & more
        return on

    found = let(
        flags,
        lambda f: find_matches(
            text, [r.search_regex for r in rules], [guard(r, f) for r in rules]
        ),
    )

    trims = _numbers_by(rules, lambda r: r.trim)
    checks = _numbers_by(rules, lambda r: r.validator)

    def trimmed(m: Column) -> Column:
        value = m.getField("value")
        for trim, numbers in trims.items():
            value = F.when(
                m.getField("rule").isin(numbers), F.rtrim(m.getField("value"), F.lit(trim))
            ).otherwise(value)
        return F.struct(
            m.getField("rule").alias("rule"),
            m.getField("start").alias("start"),
            value.alias("value"),
        )

    def passes(m: Column) -> Column:
        verdict = F.lit(True)
        for validator, numbers in checks.items():
            verdict = F.when(
                m.getField("rule").isin(numbers), validator(m.getField("value"))
            ).otherwise(verdict)
        return verdict

    def column_of(values: list, number: Column) -> Column:
        if len(set(values)) == 1:
            return F.lit(values[0])
        return literal_array(values)[number]

    def to_span(m: Column) -> Column:
        number = m.getField("rule")
        return span_struct(
            entity_type=column_of([r.entity_type for r in rules], number),
            start=m.getField("start"),
            end=m.getField("start") + F.length(m.getField("value")),
            score=column_of([1.0 if r.validator else float(r.score) for r in rules], number),
            recognizer=column_of([r.recognizer for r in rules], number),
            pattern=column_of([r.name for r in rules], number),
            pattern_score=column_of([float(r.score) for r in rules], number),
            value=m.getField("value"),
        )

    if trims:
        found = F.transform(found, trimmed)
    if checks:
        found = F.filter(found, passes)
    return F.coalesce(F.transform(found, to_span), empty_array(SPAN_TYPE))


def _numbers_by(rules: Sequence[Rule], key: Callable[[Rule], Any]) -> dict[Any, list[int]]:
    """Rule numbers by a property of the rule, rules without it left out."""
    out: dict[Any, list[int]] = {}
    for number, rule in enumerate(rules):
        if key(rule):
            out.setdefault(key(rule), []).append(number)
    return out


def scan(df: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """Add ``spans`` to every row; rows with blank text get an empty array."""
    return df.withColumn("spans", scan_expr(F.col(text_col), rules))


def keep_expr(
    spans: Column,
    threshold: float | None = DEFAULT_THRESHOLD,
    allowed: Iterable[str] | None = None,
    denied: Iterable[str] = (),
) -> Column:
    """Keep spans by score and type."""
    wanted = None if allowed is None else list(allowed)
    unwanted = list(denied)
    if wanted is not None and "ALL" in wanted:
        wanted = None

    def ok(s: Column) -> Column:
        keep = F.lit(True) if threshold is None else s.getField("score") >= F.lit(float(threshold))
        if wanted is not None:
            keep = keep & s.getField("entity_type").isin(wanted)
        if unwanted:
            keep = keep & ~s.getField("entity_type").isin(unwanted)
        return keep

    return F.filter(spans, ok)


def is_valid_span(span: Column) -> Column:
    """Start not negative, end after start, score in 0..1, type and value not empty."""
    get = span.getField
    return F.coalesce(
        (get("start") >= 0)
        & (get("end") > get("start"))
        & get("score").between(0.0, 1.0)
        & (F.length(get("entity_type")) > 0)
        & (F.length(get("value")) > 0),
        F.lit(False),
    )


def split_valid(df: DataFrame, spans_col: str = "spans") -> DataFrame:
    """Move spans that break a rule of form into ``rejected``."""
    spans = F.col(spans_col)
    return df.withColumn("rejected", F.filter(spans, lambda s: ~is_valid_span(s))).withColumn(
        spans_col, F.filter(spans, is_valid_span)
    )


def boost_expr(
    spans: Column,
    text: Column,
    words: dict[str, Sequence[str]],
    window: int = 50,
    boost: float = 0.35,
) -> Column:
    """Raise the score of spans with one of their type's context words just before them."""
    by_type = {t: [w for w in ws if w] for t, ws in words.items()}

    def raised(s: Column) -> Column:
        lead_from = F.greatest(s.getField("start") - window, F.lit(0))
        lead = slice_text(text, lead_from, s.getField("start"))
        near = F.lit(False)
        for entity_type, ws in by_type.items():
            if ws:
                near = near | (
                    (s.getField("entity_type") == entity_type) & contains_any(lead, ws)
                )
        return F.when(
            near, with_fields(s, score=F.least(F.lit(1.0), s.getField("score") + F.lit(boost)))
        ).otherwise(s)

    return F.transform(spans, raised)


def rule_context(rules: Iterable[Rule]) -> dict[str, list[str]]:
    """Context words of ``rules`` by entity type."""
    out: dict[str, list[str]] = {}
    for r in rules:
        words = out.setdefault(r.entity_type, [])
        words += [w for w in r.context if w not in words]
    return out


def explode_spans(df: DataFrame, *keys: str, spans_col: str = "spans") -> DataFrame:
    """One row per span, the key columns kept.

    The array passes through ``filter`` on its way: ``inline`` over a bare column
    makes the optimizer test the array's size below the scan, which would run
    every rule twice.
    """
    spans = F.filter(F.col(spans_col), lambda s: s.isNotNull())
    return df.select(*keys, F.inline(spans))


def language_or_default(lang: Column, default: str = DEFAULT_LANGUAGE) -> Column:
    """Null and ``auto`` stand for the default language."""
    return F.coalesce(F.nullif(lang, F.lit("auto")), F.lit(default))


def entity_list(csv: Column) -> Column:
    """``"A, B,,C"`` as an array of trimmed, non-blank names."""
    return F.filter(
        F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != ""
    )
