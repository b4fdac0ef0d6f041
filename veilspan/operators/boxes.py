"""Word boxes of scanned pages: which of them a span covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_starts
from .joins import bucket_of, buckets_of
from .transcript import CHAR_BUCKET

PLACE = ["word_no", "text", "left", "top", "width", "height", "conf"]


def page_text(df: DataFrame, words_col: str = "words") -> DataFrame:
    """Add ``text``: the words of a page joined by one space."""
    return df.withColumn(
        "text", F.array_join(F.transform(words_col, lambda w: w.getField("text")), " ")
    )


def _placed(words: Column) -> Column:
    starts = running_starts(F.transform(words, lambda w: F.length(w.getField("text")) + 1))
    return let(
        starts,
        lambda at: F.transform(
            words,
            lambda w, i: F.struct(
                w.alias("box"),
                at[i].alias("c0"),
                (at[i] + F.length(w.getField("text"))).alias("c1"),
            ),
        ),
    )


def explode_words(
    df: DataFrame, *keys: str, words_col: str = "words", spans_col: str | None = None
) -> DataFrame:
    """One row per word with its offsets in the page text.

    With ``spans_col``, pages without spans are left out before words are laid out.
    """
    words = F.col(words_col)
    if spans_col is not None:
        words = F.when(F.size(spans_col) > 0, words)
    return df.select(*keys, F.inline(let(words, _placed))).select(*keys, "box.*", "c0", "c1")


def page_boxes(df: DataFrame, *keys: str, words_col: str = "words") -> DataFrame:
    """``covered_boxes`` where a page's words and spans are arrays on one row: no join.

    One row per span and word. Words are laid out only on pages with spans.
    """

    def of_span(s: Column, words: Column, word_at: Column) -> Column:
        get = s.getField
        first, last = F.get(word_at, get("start")), F.get(word_at, get("end") - 1)
        near = F.slice(words, first + 1, F.greatest(F.coalesce(last, F.size(words) - 1) - first + 1, F.lit(0)))
        inside = F.filter(
            near, lambda w: (w.getField("c0") < get("end")) & (w.getField("c1") > get("start"))
        )
        return F.transform(
            inside,
            lambda w: F.struct(
                get("entity_type").alias("entity_type"),
                get("start").alias("start"),
                get("end").alias("end"),
                *[
                    w.getField("box").getField(n).alias(n)
                    for n in ("word_no", "left", "top", "width", "height")
                ],
            ),
        )

    covered = F.when(
        F.size("spans") > 0,
        let(
            let(F.col(words_col), _placed),
            lambda words: let(
                # the word at, or before, every character of the page
                F.flatten(
                    F.transform(words, lambda w, i: F.array_repeat(i, w.getField("c1") - w.getField("c0") + 1))
                ),
                lambda word_at: F.flatten(F.transform("spans", lambda s: of_span(s, words, word_at))),
            ),
        ),
    )
    return df.select(*keys, F.inline(F.filter(covered, lambda b: b.isNotNull())))


def covered_boxes(
    spans: DataFrame, words: DataFrame, keys: list[str], width: int = CHAR_BUCKET
) -> DataFrame:
    """Boxes of the words that a span overlaps, one row per span and word.

    ``words`` have ``c0``/``c1``. Both sides are laid out over stretches of text
    and meet in the first stretch they share, so no pair comes up twice and a
    crowded page is spread over tasks.
    """
    s = spans.select(
        *keys,
        "entity_type",
        "start",
        "end",
        F.explode(buckets_of(F.col("start"), F.col("end") - 1, width)).alias("bucket"),
    )
    w = words.select(
        *keys,
        "word_no", "left", "top", "width", "height", "c0", "c1",
        F.explode(buckets_of(F.col("c0"), F.col("c1") - 1, width)).alias("bucket"),
    )
    meet = F.greatest(bucket_of(F.col("start"), width), bucket_of(F.col("c0"), width))
    return (
        s.join(w, [*keys, "bucket"])
        .filter(
            (F.col("c0") < F.col("end")) & (F.col("c1") > F.col("start")) & (F.col("bucket") == meet)
        )
        .select(*keys, "entity_type", "start", "end", "word_no", "left", "top", "width", "height")
    )
