"""Transcripts: words with times, spans on the time axis, speakers, cut lists.

Rows of a transcript may pile up under one recording. Joins and windows here are
therefore keyed by recording *and* a stretch of its text or time axis, so that
no task has to hold a recording whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import empty_array, fold_emit, let, running_starts, step_result
from .joins import bucket_of, buckets_of, join_within

WORD_TYPE = "struct<c0:int,c1:int,word_no:int,word:string,t0:double,t1:double>"
CHAR_BUCKET = 512
#: Characters of a text that are looked through for the next words.
AHEAD = 2048
TIME_BUCKET = 60.0
SAMPLE_RATE = 22_050


# --- nested transcripts, one recording per row ---------------------------------


def transcript_text(df: DataFrame, segments_col: str = "segments") -> DataFrame:
    """Add ``text``: segment texts joined by one space."""
    return df.withColumn(
        "text", F.array_join(F.transform(segments_col, lambda s: s.getField("text")), " ")
    )


def flatten_words(df: DataFrame, *keys: str) -> DataFrame:
    """One row per word: segments[] then words[]."""
    segments = df.select(*keys, F.posexplode("segments").alias("seg_no", "seg"))
    return segments.select(
        *keys, "seg_no", F.posexplode("seg.words").alias("word_no", "w")
    ).select(
        *keys,
        "seg_no",
        "word_no",
        F.col("w.word").alias("word"),
        F.col("w.start").alias("t0"),
        F.col("w.end").alias("t1"),
        F.col("w.score").alias("score"),
    )


def _interval(
    c0: Column, c1: Column, word_no: Column, word: Column, t0: Column, t1: Column
) -> Column:
    return F.struct(
        c0.alias("c0"), c1.alias("c1"), word_no.alias("word_no"), word.alias("word"),
        t0.alias("t0"), t1.alias("t1"),
    ).cast(WORD_TYPE)


def segment_intervals_expr(
    text: Column, words: Column, seg_start: Column, seg_end: Column
) -> Column:
    """Character intervals of one segment with the times that hold for them.

    Words are located left to right. Characters between words take the next
    word's start for both times; those after the last word take its end. A word
    that is not in the text is passed over. Where words or their times are
    missing, the segment's times hold for the whole segment, and no word is
    named.
    """
    nothing = F.lit(None)
    whole = F.array(_interval(F.lit(0), F.length(text), nothing, nothing, seg_start, seg_end))
    # A stretch of the text ahead is carried along: locating a word from an offset, or cutting the
    # whole rest off, would walk through the text for every word.
    start = F.struct(
        F.lit(0).alias("pos"), F.substring(text, 1, AHEAD).alias("ahead"), F.lit(None).cast("double").alias("time"),
        F.length(text).alias("length"),
    )
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("no")))

    def step(state: Column, item: Column) -> Column:
        w, pos = item.getField("w"), state.getField("pos")
        size = F.length(w.getField("word"))

        def placed(ahead: Column, skip: Column) -> Column:
            at = pos + skip
            gap = _interval(pos, at, nothing, nothing, w.getField("start"), w.getField("start"))
            here = _interval(
                at, at + size, item.getField("no"), w.getField("word"),
                w.getField("start"), w.getField("end"),
            )
            nxt = F.struct(
                (at + size).alias("pos"),
                F.substr(ahead, skip + size + 1).alias("ahead"),
                w.getField("end").cast("double").alias("time"),
                state.getField("length").alias("length"),
            )
            return F.when(
                (skip >= 0) & (size > 0),
                step_result(nxt, F.when(skip > 0, F.array(gap, here)).otherwise(F.array(here))),
            ).otherwise(step_result(state, empty_array(WORD_TYPE)))

        def search(ahead: Column) -> Column:
            def found(at: Column) -> Column:
                return F.when(at > 0, at - 1).otherwise(F.instr(F.substr(text, pos + 1), w.getField("word")) - 1)

            return let(
                let(F.instr(ahead, w.getField("word")), found), lambda skip: placed(ahead, skip)
            )

        held = state.getField("ahead")
        low = (F.length(held) < AHEAD // 2) & (pos + F.length(held) < state.getField("length"))
        return let(F.when(low, F.substring(text, pos + 1, F.lit(AHEAD))).otherwise(held), search)

    def with_tail(r: Column) -> Column:
        state = r.getField("state")
        tail = _interval(
            state.getField("pos"), F.length(text), nothing, nothing,
            state.getField("time"), state.getField("time"),
        )
        return (
            F.when(F.size(r.getField("out")) == 0, whole)
            .when(
                state.getField("pos") < F.length(text), F.concat(r.getField("out"), F.array(tail))
            )
            .otherwise(r.getField("out"))
        )

    timed = (F.size(words) > 0) & F.forall(words, lambda w: w.getField("start").isNotNull())
    return F.when(
        F.coalesce(timed, F.lit(False)), let(fold_emit(numbered, start, step, WORD_TYPE), with_tail)
    ).otherwise(whole)


def intervals_expr(segments: Column) -> Column:
    """All character intervals of a recording, offsets counted in the joined text.

    They follow each other without a gap. The space between two segments takes the end
    time of the first.
    """

    def place(segs: Column) -> Column:
        starts = running_starts(F.transform(segs, lambda s: F.length(s.getField("text")) + 1))
        return let(
            starts,
            lambda at: F.flatten(
                F.transform(
                    segs,
                    lambda s, i: F.transform(
                        F.concat(
                            segment_intervals_expr(
                                s.getField("text"), s.getField("words"),
                                s.getField("start"), s.getField("end"),
                            ),
                            F.when(
                                i < F.size(segs) - 1,
                                F.array(
                                    _interval(
                                        F.length(s.getField("text")),
                                        F.length(s.getField("text")) + 1,
                                        F.lit(None), F.lit(None),
                                        s.getField("end"), s.getField("end"),
                                    )
                                ),
                            ).otherwise(empty_array(WORD_TYPE)),
                        ),
                        lambda w: _interval(
                            w.getField("c0") + at[i], w.getField("c1") + at[i],
                            w.getField("word_no"), w.getField("word"), w.getField("t0"), w.getField("t1"),
                        ),
                    ),
                )
            ),
        )

    return F.filter(let(segments, place), lambda w: w.getField("c1") > w.getField("c0"))


def word_intervals(df: DataFrame, *keys: str) -> DataFrame:
    """Long form of ``intervals_expr``."""
    return df.select(*keys, F.inline(intervals_expr(F.col("segments"))))


# --- spans on the time axis -----------------------------------------------------


def span_times(
    spans: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    span_keys: list[str] | None = None,
    interpolate: bool = True,
    width: int = CHAR_BUCKET,
) -> DataFrame:
    """Add ``start_time`` and ``end_time`` to spans.

    The times are those of the intervals under the first and the last character.
    If both lie in one word and ``interpolate`` is set, the word's time is shared
    out evenly over its characters. Each end is looked up in the one interval that
    holds it, by recording and stretch of text. Spans outside all intervals get null.
    """
    span_keys = span_keys or ["start", "end", "entity_type", "pattern"]
    own = [c for c in spans.columns if c not in keys]
    ends = F.array(
        F.struct(F.lit("first").alias("side"), F.col("start").alias("at")),
        F.struct(F.lit("last").alias("side"), (F.col("end") - 1).alias("at")),
    )
    points = spans.select(*keys, *own, F.inline(ends)).withColumn(
        "bucket", bucket_of(F.col("at"), width)
    )
    places = intervals.select(
        *keys,
        "c0", "c1", "word", "t0", "t1",
        F.explode(buckets_of(F.col("c0"), F.col("c1") - 1, width)).alias("bucket"),
    )
    inside = (F.col("c0") <= F.col("at")) & (F.col("at") < F.col("c1"))
    joined = join_within(points, places, [*keys, "bucket"], inside)
    place = F.struct("c0", "c1", "word", "t0", "t1")
    rest = [c for c in own if c not in span_keys]
    both = joined.groupBy(*keys, *span_keys).agg(
        *[F.first(c).alias(c) for c in rest],
        F.max(F.when(F.col("side") == "first", place)).alias("a"),
        F.max(F.when(F.col("side") == "last", place)).alias("b"),
    )
    one_word = F.lit(False)
    if interpolate:
        one_word = F.coalesce(
            (F.col("a.c0") == F.col("b.c0")) & F.col("a.word").isNotNull(), F.lit(False)
        )
    per_char = (F.col("a.t1") - F.col("a.t0")) / (F.col("a.c1") - F.col("a.c0"))
    return both.select(
        *keys,
        *own,
        F.when(one_word, F.col("a.t0") + (F.col("start") - F.col("a.c0")) * per_char)
        .otherwise(F.col("a.t0"))
        .alias("start_time"),
        F.when(one_word, F.col("a.t0") + (F.col("end") - F.col("a.c0")) * per_char)
        .otherwise(F.col("b.t1"))
        .alias("end_time"),
    )


def row_span_times(
    df: DataFrame, *keys: str, interpolate: bool = True, fields: tuple[str, ...] = ("entity_type", "pattern", "start", "end", "value")
) -> DataFrame:
    """``span_times`` where a recording's spans and segments stand on one row: no join, no shuffle.

    One row per span with ``keys``, ``fields``, ``start_time`` and ``end_time``. Words are laid
    out only for recordings with spans, once, and every span looks its two ends up by their place.
    """

    def timed(words: Column) -> Column:
        # the interval of every character, so that a span finds its ends without a search
        at = F.flatten(
            F.transform(words, lambda w, i: F.array_repeat(i, w.getField("c1") - w.getField("c0")))
        )
        return let(at, lambda where: F.transform("spans", lambda s: one(s, words, where)))

    def one(s: Column, words: Column, where: Column) -> Column:
        a = F.get(words, F.get(where, s.getField("start")))
        b = F.get(words, F.get(where, s.getField("end") - 1))
        return let(F.struct(a.alias("a"), b.alias("b")), lambda x: out(s, x.getField("a"), x.getField("b")))

    def out(s: Column, a: Column, b: Column) -> Column:
        one_word = F.lit(False)
        if interpolate:
            same = (a.getField("c0") == b.getField("c0")) & a.getField("word").isNotNull()
            one_word = F.coalesce(same, F.lit(False))
        per_char = (a.getField("t1") - a.getField("t0")) / (a.getField("c1") - a.getField("c0"))

        def inside(place: str) -> Column:
            return a.getField("t0") + (s.getField(place) - a.getField("c0")) * per_char

        return F.struct(
            *[s.getField(f).alias(f) for f in fields],
            F.when(one_word, inside("start")).otherwise(a.getField("t0")).alias("start_time"),
            F.when(one_word, inside("end")).otherwise(b.getField("t1")).alias("end_time"),
        )

    spans = F.when(F.size("spans") > 0, let(intervals_expr(F.col("segments")), timed))
    return df.select(*keys, F.inline(F.filter(spans, lambda s: s.isNotNull())))


def span_speakers(
    spans: DataFrame, turns: DataFrame, keys: list[str], span_keys: list[str] | None = None,
    width: float = TIME_BUCKET,
) -> DataFrame:
    """Add ``speaker_id``: the earliest turn that holds the middle of the span, or null."""
    span_keys = span_keys or ["start", "end", "entity_type", "pattern"]
    middle = (F.col("start_time") + F.col("end_time")) / 2
    points = spans.withColumn("middle", middle).withColumn(
        "bucket", bucket_of(F.col("middle"), width)
    )
    slots = turns.select(
        *keys,
        "speaker_id",
        F.col("start_time").alias("turn_start"),
        F.col("end_time").alias("turn_end"),
        F.explode(buckets_of(F.col("start_time"), F.col("end_time"), width)).alias("bucket"),
    )
    inside = F.col("middle").between(F.col("turn_start"), F.col("turn_end"))
    joined = join_within(points, slots, [*keys, "bucket"], inside)
    rest = [c for c in spans.columns if c not in keys and c not in span_keys]
    # Grouping by a superset of the join keys needs no further shuffle.
    return (
        joined.groupBy(*keys, "bucket", *span_keys)
        .agg(
            *[F.first(c).alias(c) for c in rest],
            F.min(F.struct("turn_start", "speaker_id")).alias("__turn"),
        )
        .select(*spans.columns, F.col("__turn.speaker_id").alias("speaker_id"))
    )


def by_speaker(spans: DataFrame) -> DataFrame:
    """Spans labelled with their speaker, ``unknown`` where there is none."""
    return spans.withColumn("speaker_id", F.coalesce("speaker_id", F.lit("unknown")))


# --- speaker turns --------------------------------------------------------------


def clean_turns(turns: DataFrame, min_duration: float = 1.0) -> DataFrame:
    return turns.filter(F.col("end_time") - F.col("start_time") >= F.lit(min_duration))


def speaker_stats(turns: DataFrame, *keys: str) -> DataFrame:
    """Per speaker: number of turns and speaking time."""
    return turns.groupBy(*keys, "speaker_id").agg(
        F.count("*").alias("n_turns"),
        F.sum(F.col("end_time") - F.col("start_time")).alias("speaking_time"),
    )


def recording_stats(turns: DataFrame, *keys: str) -> DataFrame:
    """Per recording: number of speakers and last end."""
    per_speaker = turns.groupBy(*keys, "speaker_id").agg(F.max("end_time").alias("last"))
    return per_speaker.groupBy(*keys).agg(
        F.count("*").alias("speaker_count"), F.coalesce(F.max("last"), F.lit(0.0)).alias("total_duration")
    )


def speaker_timeline(turns: DataFrame, *keys: str) -> DataFrame:
    """Turns in order. Sorted by range over all columns, so no speaker sits in one task."""
    return turns.select(*keys, "speaker_id", "start_time", "end_time").orderBy(
        *keys, "speaker_id", "start_time", "end_time"
    )


# --- intervals ------------------------------------------------------------------


def clip_to_buckets(df: DataFrame, lo: str, hi: str, width: int | float) -> DataFrame:
    """Cut intervals at bucket borders; adds ``bucket``."""
    kind = df.schema[lo].dataType
    number = F.explode(buckets_of(F.col(lo), F.col(hi), width)).alias("bucket")
    cut = df.select("*", number)
    border = (F.col("bucket") * F.lit(width)).cast(kind)
    return (
        cut.withColumn(lo, F.greatest(F.col(lo), border))
        .withColumn(hi, F.least(F.col(hi), (border + F.lit(width)).cast(kind)))
        .filter(F.col(lo) < F.col(hi))
    )


def _islands(df: DataFrame, keys: list[str], lo: str, hi: str, carry: list[Column]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col(lo) <= reach, F.lit(0)).otherwise(F.lit(1))
    numbered = df.withColumn("__opens", opens).withColumn(
        "__island", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*keys, "__island").agg(
        F.min(lo).alias(lo), F.max(hi).alias(hi), *carry
    ).drop("__island")


def merge_intervals(
    df: DataFrame, keys: list[str], lo: str, hi: str, width: int | float
) -> DataFrame:
    """Union of overlapping or touching intervals, with ``n`` pieces merged in each.

    Two steps. Intervals are cut at bucket borders and merged within (keys,
    bucket); then only what touches a border is stitched across buckets, at most
    two rows per bucket, so one key with most of the rows still spreads.
    """
    kind = df.schema[lo].dataType
    pieces = clip_to_buckets(
        df.select(*keys, lo, hi).withColumn("__from", F.col(lo)), lo, hi, width
    ).withColumn("__own", F.when(F.col(lo) == F.col("__from"), 1).otherwise(0))
    local = _islands(
        pieces, [*keys, "bucket"], lo, hi, [F.sum("__own").alias("n")]
    )
    low_border = (F.col("bucket") * F.lit(width)).cast(kind)
    at_border = (F.col(lo) == low_border) | (F.col(hi) == (low_border + F.lit(width)).cast(kind))
    local = local.withColumn("__border", at_border)
    inner = local.filter(~F.col("__border")).select(*keys, lo, hi, "n")
    stitched = _islands(
        local.filter("__border").select(*keys, lo, hi, "n"), keys, lo, hi, [F.sum("n").alias("n")]
    )
    return inner.unionByName(stitched.select(*keys, lo, hi, "n"))


def overlapped_speech(turns: DataFrame, *keys: str, width: float = TIME_BUCKET) -> DataFrame:
    """Seconds per recording during which two or more speakers talk."""
    talk = clip_to_buckets(
        turns.select(*keys, "speaker_id", "start_time", "end_time"), "start_time", "end_time", width
    )
    own = _islands(talk, [*keys, "bucket", "speaker_id"], "start_time", "end_time", [])
    events = own.select(
        *keys,
        "bucket",
        F.inline(
            F.array(
                F.struct(F.col("start_time").alias("t"), F.lit(1).alias("d")),
                F.struct(F.col("end_time").alias("t"), F.lit(-1).alias("d")),
            )
        ),
    )
    order = Window.partitionBy(*keys, "bucket").orderBy("t", "d")
    steps = events.withColumn(
        "talking", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("until", F.lead("t").over(order))
    return steps.groupBy(*keys).agg(
        F.coalesce(
            F.sum(F.when(F.col("talking") >= 2, F.col("until") - F.col("t"))), F.lit(0.0)
        ).alias("overlap_time")
    )


# --- cut lists ------------------------------------------------------------------


def beep_edits(
    spans: DataFrame, length_col: str = "n_samples", sample_rate: int = SAMPLE_RATE
) -> DataFrame:
    """Sample ranges to overwrite: times become samples, clamped to the recording.

    Spans without times have no place to cut: see ``beep_rejects``. A recording of unknown
    length clamps nothing, so that its cuts stay.
    """
    spans = spans.filter("start_time IS NOT NULL AND end_time IS NOT NULL")
    first = F.greatest(F.lit(0).cast("long"), (F.col("start_time") * sample_rate).cast("long"))
    until = (F.col("end_time") * sample_rate).cast("long")
    last = F.least(F.coalesce(F.col(length_col).cast("long"), until), until)
    return (
        spans.withColumn("start_sample", first)
        .withColumn("end_sample", last)
        .filter("start_sample < end_sample")
    )


def beep_rejects(spans: DataFrame) -> DataFrame:
    """Spans that ``beep_edits`` cannot place on the time axis, with ``error``."""
    return spans.filter("start_time IS NULL OR end_time IS NULL").withColumn("error", F.lit("span without times"))


def beep_islands(
    edits: DataFrame, *keys: str, sample_rate: int = SAMPLE_RATE, seconds: int = 60
) -> DataFrame:
    """Cut list with overlapping and touching ranges merged."""
    return merge_intervals(
        edits, list(keys), "start_sample", "end_sample", sample_rate * seconds
    )


def segment_quality(segments: DataFrame, length_ms: Column | None = None) -> DataFrame:
    """Clip ranges for voice data, with word confidence and a ``keep`` verdict.

    A clip starts 0.08 s before its segment, the first one at the segment, and
    runs 80 ms past its end. Kept clips last more than 1.5 and less than 20 s and
    have 2 to 199 characters. Needs ``seg_no``, ``start``, ``end``, ``text``,
    ``word_scores``.
    """
    lead = F.when(F.col("seg_no") == 0, F.col("start")).otherwise(F.col("start") - F.lit(0.08))
    from_ms = (F.greatest(F.lit(0.0), lead) * 1000).cast("long")
    to_ms = (F.col("end") * 1000).cast("long") + 80
    if length_ms is not None:
        to_ms = F.least(length_ms, to_ms)
    scores = F.col("word_scores")
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    text = F.replace(F.col("text"), F.lit("..."), F.lit(""))
    return (
        segments.withColumn("text", text)
        .withColumn("from_ms", from_ms)
        .withColumn("to_ms", to_ms)
        .withColumn(
            "confidence", F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(F.lit(0.0))
        )
        .withColumn("duration", (F.col("to_ms") - F.col("from_ms")) / 1000.0)
        .withColumn(
            "keep",
            (F.col("duration") > 1.5)
            & (F.col("duration") < 20.0)
            & (F.length("text") >= 2)
            & (F.length("text") < 200),
        )
    )


def resplit_equal(
    df: DataFrame, *keys: str, duration: str = "duration", seconds: float = 10.0
) -> DataFrame:
    """Equal parts of about ``seconds``; anything too short to round to one part has none."""
    parts = F.bround(F.col(duration) / F.lit(seconds)).cast("int")
    numbers = F.when(parts > 0, F.sequence(F.lit(0), parts - 1)).otherwise(empty_array("int"))
    cut = df.select(*keys, duration, parts.alias("n"), F.explode(numbers).alias("part_no"))
    step = F.col(duration) / F.col("n")
    return cut.select(
        *keys,
        "part_no",
        (F.col("part_no") * step).alias("start_time"),
        F.when(F.col("part_no") == F.col("n") - 1, F.col(duration))
        .otherwise((F.col("part_no") + 1) * step)
        .alias("end_time"),
    )


def resplit_rejects(df: DataFrame, *keys: str, duration: str = "duration", seconds: float = 10.0) -> DataFrame:
    """Recordings that ``resplit_equal`` gives no part: too short, or of unknown length."""
    parts = F.bround(F.col(duration) / F.lit(seconds)).cast("int")
    error = F.when(F.col(duration).isNull(), "recording of unknown length").otherwise("recording too short to split")
    return df.filter(F.coalesce(parts, F.lit(0)) <= 0).select(*keys, duration, error.alias("error"))
