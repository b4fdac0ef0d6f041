"""Cut texts into segments. Segments stay an array on the text's own row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import empty_array, fold_emit, let, running_starts, step_result
from ..functions.text import EDGE_SPACE, is_blank, portable_regex
from .offsets import running_offsets
from .resolve import dedupe_expr
from .rules import Rule
from .scan import scan_expr, with_fields

SEGMENT_TYPE = "struct<start:int,end:int,text:string>"
SENTENCE_MARKS = "。！？.!?"
WHITE_SPACE = r"\p{IsWhite_Space}"


def _segment(start: Column, text: Column) -> Column:
    return F.struct(
        start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text")
    )


def _not_blank(segment: Column) -> Column:
    return F.length(F.trim(segment.getField("text"), F.lit(EDGE_SPACE))) > 0


def _placed(pieces: Column) -> Column:
    """Pieces that follow each other without a gap, with their offsets."""
    return let(
        pieces,
        lambda p: let(
            running_starts(F.transform(p, F.length)),
            lambda starts: F.transform(p, lambda t, i: _segment(starts[i], t)),
        ),
    )


def _length_between(segments: Column, low: int | None, high: int | None) -> Column:
    if low is None and high is None:
        return segments
    return F.filter(segments, lambda s: _in_range(s, low, high))


def _in_range(segment: Column, low: int | None, high: int | None) -> Column:
    length = F.length(segment.getField("text"))
    return length.between(low if low is not None else 0, high if high is not None else 2**31 - 1)


def sentences_expr(
    text: Column, min_length: int | None = None, max_length: int | None = None
) -> Column:
    """Cut after every end mark; what follows the last mark is a sentence too."""
    # Cutting at look-behinds is several times faster than matching runs of
    # characters that are not marks: long negated lists are slow per character.
    pieces = F.filter(F.split(text, f"(?<=[{SENTENCE_MARKS}])", -1), lambda p: p != "")
    return _length_between(_placed(pieces), min_length, max_length)


def pattern_parts_expr(text: Column, pattern: str) -> Column:
    """The parts of ``text`` between matches of ``pattern``."""
    regex = portable_regex(pattern)

    def placed(p: Column) -> Column:
        parts, marks = p.getField("parts"), p.getField("marks")
        steps = F.zip_with(
            parts, marks, lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0))
        )
        return let(
            running_starts(steps), lambda s: F.transform(parts, lambda t, i: _segment(s[i], t))
        )

    both = F.struct(
        F.split(text, regex, -1).alias("parts"),
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("marks"),
    )
    return let(both, placed)


def paragraphs_expr(
    text: Column,
    separators: Sequence[str] = ("\n\n", "\r\n\r\n"),
    min_length: int | None = None,
    max_length: int | None = None,
) -> Column:
    """Cut at any of the separators."""
    pattern = "|".join(re.escape(s) for s in separators)
    return _length_between(pattern_parts_expr(text, pattern), min_length, max_length)


def windows_expr(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of fixed size; each starts ``overlap`` characters before the last one ends."""
    _check_window(size, overlap)
    last = F.greatest(F.length(text) - F.lit(overlap + 1), F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return F.transform(starts, lambda s: _segment(s, F.substring(text, s + 1, F.lit(size))))


def word_windows_expr(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows that end before the last white space in them.

    A window is cut back only as far as the next one still moves on, that is,
    beyond the overlap.
    """
    _check_window(size, overlap)
    length = F.length(text)
    done = F.lit(-1)

    def step(pos: Column, _: Column) -> Column:
        def cut(window: Column) -> Column:
            is_last = pos + size >= length
            room = F.when(is_last, F.length(window)).otherwise(
                F.length(F.regexp_extract(window, f"(?s)^(.*){WHITE_SPACE}", 1))
            )
            taken = let(
                room,
                lambda r: F.when(is_last | (r > overlap), r).otherwise(F.lit(size)),
            )
            return let(
                taken,
                lambda n: step_result(
                    F.when(is_last, done).otherwise(pos + n - overlap),
                    F.array(_segment(pos, F.substring(window, F.lit(1), n))),
                ),
            )

        return F.when(pos < 0, step_result(pos, empty_array(SEGMENT_TYPE))).otherwise(
            let(F.substring(text, pos + 1, F.lit(size)), cut)
        )

    def run(rounds: Column, pos: Column) -> Column:
        return fold_emit(F.sequence(F.lit(1), rounds), pos, step, SEGMENT_TYPE)

    # Twice the usual number of windows nearly always does. Texts with white
    # space in odd places go on for as many rounds as they could ever need.
    usual = (F.floor(length / F.lit(size - overlap)) * 2 + 2).cast("int")

    def finish(first: Column) -> Column:
        more = run(F.greatest(length, F.lit(1)), first.getField("state"))
        return F.when(first.getField("state") < 0, first.getField("out")).otherwise(
            F.concat(first.getField("out"), more.getField("out"))
        )

    return let(run(usual, F.lit(0)), finish)


def _check_window(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")


def custom_parts_expr(text: Column, patterns: Sequence[str]) -> Column:
    """The whole text cut by each pattern in turn, all parts one after the other."""
    return F.concat(*[pattern_parts_expr(text, p) for p in patterns])


def whole_expr(text: Column) -> Column:
    return F.array(_segment(F.lit(0), text))


def trim_expr(
    segments: Column, strip: bool = True, min_length: int = 1, max_length: int | None = None
) -> Column:
    """Drop blank segments, strip white space (offsets follow), keep lengths in range if one is given."""
    if not strip:
        return _length_between(F.filter(segments, _not_blank), min_length, max_length)

    def stripped(s: Column) -> Column:
        lead = F.length(s.getField("text")) - F.length(F.ltrim(s.getField("text"), edge))
        return let(
            F.trim(s.getField("text"), edge), lambda bare: _segment(s.getField("start") + lead, bare)
        )

    edge = F.lit(EDGE_SPACE)
    return _length_between(F.transform(segments, stripped), max(min_length, 1), max_length)


def segment(
    df: DataFrame,
    strategy: str = "sentence",
    text_col: str = "text",
    post_process: bool = True,
    **options,
) -> DataFrame:
    """Add ``segments``; blank texts get none. An unknown strategy means sentences.

    Segments have any length unless ``min_length`` or ``max_length`` is given. Those outside
    that range are not lost: they come out in a column of their own, ``outside``.
    """
    text = F.col(text_col)
    low, high = options.pop("min_length", None), options.pop("max_length", None)
    if strategy == "paragraph":
        cut = paragraphs_expr(text, **options)
    elif strategy == "fixed_length":
        respect = options.pop("respect_word_boundaries", True)
        cut = (word_windows_expr if respect else windows_expr)(text, **options)
    elif strategy == "custom" and options.get("patterns"):
        cut = custom_parts_expr(text, options["patterns"])
    elif strategy in ("custom", "whole"):
        cut = whole_expr(text)
    else:
        cut = sentences_expr(text, **options)

    def finished(parts: Column) -> Column:
        parts = trim_expr(parts) if post_process else F.filter(parts, _not_blank)
        return F.when(is_blank(text), empty_array(SEGMENT_TYPE)).otherwise(parts)

    if low is None and high is None:
        return df.withColumn("segments", finished(cut))
    beyond = F.filter(cut, lambda s: ~_in_range(s, low, high))
    return df.withColumn("segments", finished(_length_between(cut, low, high))).withColumn(
        "outside", finished(beyond)
    )


def explode_segments(df: DataFrame, *keys: str) -> DataFrame:
    """One row per segment, numbered from 0 within its text."""
    numbered = F.transform(
        "segments",
        lambda s, i: F.struct(
            i.alias("seg_no"),
            F.concat(
                F.lit("seg_"),
                F.lpad(i.cast("string"), F.greatest(F.length(i.cast("string")), F.lit(4)), F.lit("0")),
            ).alias("segment_id"),
            s.getField("start").alias("start"),
            s.getField("end").alias("end"),
            s.getField("text").alias("text"),
        ),
    )
    return df.select(*keys, F.inline(numbered))


#: Segment rows that are joined at a time.
STRETCH = 256


def segment_rows(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """Segments of a text as rows that ``merge_segments_long`` can put together again.

    Columns: ``text_no`` (a number of the row that the text stood on, so that null and repeated
    keys do not mix), ``keys``, ``seg_no``, ``n_rows`` (of the text), ``start``, ``end``, ``lead``
    (white space before the segment) and ``text``. What lies between segments and is not white
    space (texts cut out by a length range) has rows of its own, so that it is masked like the
    rest. The last row holds the white space at the end. A null text has one row with a null
    text. Segments that overlap or are out of order give one row, with a null text.
    """
    text = F.col(text_col)
    size = F.length(text)
    edge = F.lit(EDGE_SPACE)

    def numbered(s: Column) -> Column:
        bounds = F.transform(s, lambda x: F.struct(x.getField("start").alias("a"), x.getField("end").alias("b")))
        tail = F.struct(size.alias("a"), size.alias("b"))
        apart = lambda x: (x.getField("p") <= x.getField("a")) & (x.getField("a") <= x.getField("b"))

        # each worked out once a text, not once a segment
        def after(b: Column) -> Column:
            ends = F.concat(F.array(F.lit(0)), F.transform(b, lambda x: x.getField("b")))
            own = lambda p, x: F.struct(p.alias("p"), x.getField("a").alias("a"), x.getField("b").alias("b"))
            return F.zip_with(ends, F.concat(b, F.array(tail)), own)

        return let(let(bounds, after), lambda p: F.when(F.forall(p, apart), F.flatten(F.transform(p, pieces))))

    def pieces(x: Column) -> Column:
        gap = F.substring(text, x.getField("p") + 1, x.getField("a") - x.getField("p"))

        def split(g: Column) -> Column:
            bare = F.ltrim(g, edge)
            lead = F.length(g) - F.length(bare)
            between = F.trim(g, edge)
            inner = x.getField("p") + lead
            return F.when(
                bare == "", F.array(_row(x.getField("a"), x.getField("b"), g))
            ).otherwise(
                F.array(
                    _row(inner, inner + F.length(between), F.substring(g, F.lit(1), lead)),
                    _row(x.getField("a"), x.getField("b"), F.substring(g, lead + F.length(between) + 1, F.length(g))),
                )
            )

        return let(gap, split)

    def _row(a: Column, b: Column, lead: Column) -> Column:
        own = F.substring(text, a + 1, b - a)
        return F.struct(a.alias("start"), b.alias("end"), lead.alias("lead"), own.alias("text"))

    none = F.array(F.lit(None).cast("struct<start:int,end:int,lead:string,text:string>"))
    found = F.coalesce(let(F.coalesce("segments", empty_array(SEGMENT_TYPE)), numbered), none)

    # with their number in each of them: a size of the array beside its generator would put the whole array on every row
    def counted(r: Column) -> Column:
        fields = lambda x, i: [i.alias("seg_no"), F.size(r).alias("n_rows"), *[x.getField(c).alias(c) for c in ("start", "end", "lead", "text")]]
        return F.transform(r, lambda x, i: F.struct(*fields(x, i)))

    own = df.select(F.monotonically_increasing_id().alias("text_no"), *keys, let(found, counted).alias("__rows"))
    return own.select("text_no", *keys, F.inline("__rows"))


def _joined_stretches(rows: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """Up to ``STRETCH`` segments as one row each: text_no, part_no, keys, n, n_rows, part, lost."""
    piece = F.struct("seg_no", F.concat("lead", F.col(text_col)).alias("piece"))
    stretch = F.expr(f"seg_no div {STRETCH}").alias("part_no")
    # numbers are counted in the list: a distinct count would group all rows by number first
    lists = rows.groupBy("text_no", stretch).agg(
        *[F.first(k).alias(k) for k in keys],
        F.count("*").alias("n"),
        F.max("n_rows").alias("n_rows"),
        F.sort_array(F.collect_list(piece)).alias("__pieces"),
    )
    numbers, pieces = F.col("__pieces.seg_no"), F.col("__pieces.piece")
    return lists.select(
        "text_no", "part_no", *keys, "n",
        F.size(F.array_distinct(F.array_compact(numbers))).cast("long").alias("n_own"),
        "n_rows",
        F.exists(pieces, lambda x: x.isNull()).alias("lost"),
        F.array_join(pieces, "").alias("part"),
    )


def _merge_error(n: Column, n_own: Column, n_rows: Column, lost: Column) -> Column:
    return F.when(lost, "a segment has no text").when(
        (n != n_rows) | (n_own != n_rows), "segments are missing or stand twice"
    )


def merge_segments_long(
    rows: DataFrame, *keys: str, text_col: str = "redacted_text", name: str = "redacted_text"
) -> DataFrame:
    """Texts from masked ``segment_rows``, one row each: text_no, keys, ``name`` and error.

    Segments are joined in order, in stretches of ``STRETCH``, then the stretches, with what lay
    between them. Nothing masked, the text is the same to the byte. A text with a null segment (one
    that could not be masked), or without some of its segments, is null and has an error. Texts
    too long for one row come out of ``merge_segments_parts``.
    """
    stretches = _joined_stretches(rows, keys, text_col)
    whole = stretches.groupBy("text_no").agg(
        *[F.first(k).alias(k) for k in keys],
        _merge_error(F.sum("n"), F.sum("n_own"), F.max("n_rows"), F.bool_or("lost")).alias("error"),
        F.expr("listagg(part, '') WITHIN GROUP (ORDER BY part_no)").alias("__text"),
    )
    return whole.select("text_no", *keys, F.when(F.col("error").isNull(), F.col("__text")).alias(name), "error")


def merge_segments_parts(
    rows: DataFrame, *keys: str, text_col: str = "redacted_text", name: str = "redacted_text"
) -> DataFrame:
    """``merge_segments_long`` for texts of any length: text_no, keys, part_no, ``start`` in the text, ``name``, error.

    The parts of a text, in order of ``part_no``, follow each other without a gap. All parts of
    a text with an error are null.
    """
    stretches = _joined_stretches(rows, keys, text_col)
    bad = stretches.groupBy("text_no").agg(
        _merge_error(F.sum("n"), F.sum("n_own"), F.max("n_rows"), F.bool_or("lost")).alias("error")
    )
    judged = stretches.join(bad, "text_no").withColumn("__text", F.when(F.col("error").isNull(), F.col("part")))
    placed = running_offsets(judged.withColumn("__n", F.length("__text")), ["text_no"], "part_no", "__n", "start")
    return placed.select("text_no", *keys, "part_no", "start", F.col("__text").alias(name), "error")


def scan_segments(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``spans`` found inside single segments, with offsets in the whole text.

    Spans found in more than one (overlapping) segment count once.
    """

    def in_segment(s: Column) -> Column:
        return F.transform(
            scan_expr(s.getField("text"), rules),
            lambda span: with_fields(
                span,
                start=span.getField("start") + s.getField("start"),
                end=span.getField("end") + s.getField("start"),
            ),
        )

    return df.withColumn("spans", dedupe_expr(F.flatten(F.transform("segments", in_segment))))


def segment_with(
    df: DataFrame,
    function: Callable[[str], Iterable[tuple[int, int, str]]],
    key: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Segments from a Python function of the text, in Arrow batches.

    ``function`` gives ``(start, end, text)`` tuples. Where it raises, the whole text is
    the one segment and ``error`` says why; elsewhere ``error`` is null. Blank texts have no
    segments.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {PIECES}"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(own, *row) for row in _pieces(function, text)]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            types = [batch.schema.field(0).type, *PIECE_TYPES.values()]
            arrays = [pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, *PIECE_TYPES])

    return df.select(F.col(key), F.col(text_col)).mapInArrow(cut, schema)


PIECES = "seg_no int, segment_id string, start int, end int, text string, error string"
PIECE_TYPES = {
    "seg_no": pa.int32(), "segment_id": pa.string(), "start": pa.int32(), "end": pa.int32(), "text": pa.string(),
    "error": pa.string(),
}


def _pieces(function: Callable[[str], Iterable[tuple[int, int, str]]], text: str | None) -> list[tuple]:
    """Numbered segments of one text; the whole text and an error where the function fails."""
    if text is None or not text.strip():
        return []
    error = None
    try:
        parts = [(int(a), int(b), str(t)) for a, b, t in function(text)]
    except Exception as e:  # the caller's code: its failure is part of the result
        parts, error = [(0, len(text), text)], f"{type(e).__name__}: {e}"
    return [(n, f"seg_{n:04d}", a, b, t, error) for n, (a, b, t) in enumerate(parts)]


def register_segmenter(
    spark: SparkSession, name: str, function: Callable[[str], Iterable[tuple[int, int, str]]]
) -> None:
    """Make a Python function of a text a table function of SQL: ``FROM t, LATERAL name(t.text)``.

    Columns are those of ``segment_with`` but for the key. A blank text has no rows, so that
    ``LEFT JOIN LATERAL name(t.text) ON true`` keeps its key. Rows travel a few at a time: an Arrow
    batch holds as many texts as the session allows rows, however long they are.
    """

    class Segmenter:
        def eval(self, text: str) -> Iterable[tuple]:
            yield from _pieces(function, text)

    spark.udtf.register(name, F.udtf(Segmenter, returnType=PIECES, useArrow=False))
