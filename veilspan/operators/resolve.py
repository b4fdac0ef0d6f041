"""De-duplicate spans and settle overlaps, inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import empty_array, fold_emit, let, step_result
from ..functions.text import slice_text
from .scan import SPAN_TYPE, with_fields


def dedupe_expr(spans: Column) -> Column:
    """One span per (type, start, end): the best score, then the first pattern name."""

    def keyed(s: Column) -> Column:
        get = s.getField
        return F.struct(
            get("start").alias("start"),
            get("end").alias("end"),
            get("entity_type").alias("entity_type"),
            (-get("score")).alias("neg_score"),
            get("pattern").alias("pattern"),
            s.alias("span"),
        )

    def first_of_key(sorted_spans: Column) -> Column:
        def is_first(s: Column, i: Column) -> Column:
            before = sorted_spans[F.greatest(i - 1, F.lit(0))]
            same = F.lit(True)
            for name in ("start", "end", "entity_type"):
                same = same & (before.getField(name) == s.getField(name))
            return (i == 0) | ~same

        return F.transform(F.filter(sorted_spans, is_first), lambda s: s.getField("span"))

    return let(F.array_sort(F.transform(spans, keyed)), first_of_key)


_RANK_TYPE = (
    "struct<neg_score:double,neg_pattern_score:double,neg_length:int,"
    f"start:int,entity_type:string,pattern:string,span:{SPAN_TYPE}>"
)
_ISLAND_TYPE = f"struct<lo:int,hi:int,best:{_RANK_TYPE}>"


def cover_expr(spans: Column, text: Column) -> Column:
    """Merge each run of overlapping spans into one span over all of them.

    The merged span takes its labels from its best member: score, pattern score,
    length, then earliest start and type name. Every detected character stays
    covered, so this is the form to mask by.
    """

    def island(s: Column) -> Column:
        get = s.getField
        return F.struct(
            get("start").alias("lo"),
            get("end").alias("hi"),
            F.struct(
                (-get("score")).alias("neg_score"),
                (-get("pattern_score")).alias("neg_pattern_score"),
                (get("start") - get("end")).alias("neg_length"),
                get("start").alias("start"),
                get("entity_type").alias("entity_type"),
                get("pattern").alias("pattern"),
                s.alias("span"),
            ).alias("best"),
        ).cast(_ISLAND_TYPE)

    def step(current: Column, nxt: Column) -> Column:
        apart = current.isNull() | (nxt.getField("lo") >= current.getField("hi"))
        joined = F.struct(
            current.getField("lo").alias("lo"),
            F.greatest(current.getField("hi"), nxt.getField("hi")).alias("hi"),
            F.least(current.getField("best"), nxt.getField("best")).alias("best"),
        )
        return step_result(
            F.when(apart, nxt).otherwise(joined),
            F.when(apart & current.isNotNull(), F.array(current)).otherwise(
                empty_array(_ISLAND_TYPE)
            ),
        )

    def label(i: Column) -> Column:
        return with_fields(
            i.getField("best").getField("span"),
            start=i.getField("lo"),
            end=i.getField("hi"),
            value=slice_text(text, i.getField("lo"), i.getField("hi")),
        )

    islands = F.array_sort(F.transform(spans, island))
    folded = fold_emit(islands, F.lit(None).cast(_ISLAND_TYPE), step, _ISLAND_TYPE)
    return let(
        folded,
        lambda r: F.transform(
            F.concat(r.getField("out"), F.array_compact(F.array(r.getField("state")))), label
        ),
    )


def greedy_expr(spans: Column, span_type: str = SPAN_TYPE) -> Column:
    """Keep the better of two overlapping spans, in order of start, score and array place.

    A span that overlaps the last kept one replaces it if it scores higher and is
    dropped otherwise. Kept spans never overlap, but a dropped span may leave
    characters uncovered: a form for reports, not for masking.
    """
    keyed_type = f"struct<start:int,neg_score:double,place:int,end:int,span:{span_type}>"

    def keyed(s: Column, place: Column) -> Column:
        get = s.getField
        return F.struct(
            get("start").alias("start"),
            (-get("score")).alias("neg_score"),
            place.alias("place"),
            get("end").alias("end"),
            s.alias("span"),
        ).cast(keyed_type)

    def step(last: Column, nxt: Column) -> Column:
        apart = last.isNull() | (nxt.getField("start") >= last.getField("end"))
        better = nxt.getField("neg_score") < last.getField("neg_score")
        return step_result(
            F.when(apart | better, nxt).otherwise(last),
            F.when(apart & last.isNotNull(), F.array(last)).otherwise(empty_array(keyed_type)),
        )

    folded = fold_emit(
        F.array_sort(F.transform(spans, keyed)), F.lit(None).cast(keyed_type), step, keyed_type
    )
    return let(
        folded,
        lambda r: F.transform(
            F.concat(r.getField("out"), F.array_compact(F.array(r.getField("state")))),
            lambda k: k.getField("span"),
        ),
    )


def resolve(
    df: DataFrame, mode: str = "cover", spans_col: str = "spans", text_col: str = "text"
) -> DataFrame:
    """De-duplicate, then settle overlaps by ``cover``, ``greedy`` or not at all (``none``)."""
    spans = dedupe_expr(F.col(spans_col))
    if mode == "cover":
        spans = cover_expr(spans, F.col(text_col))
    elif mode == "greedy":
        spans = greedy_expr(spans)
    elif mode != "none":
        raise ValueError(f"unknown overlap mode {mode!r}")
    return df.withColumn(spans_col, spans)
