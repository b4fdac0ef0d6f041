"""From transcripts and speaker turns to spans in time, masked text and cut lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import transcript as tr
from ..operators.redact import Policy
from ..operators.scan import explode_spans
from .text import analyze, anonymize

KEY = "audio_id"


def detect(
    transcripts: DataFrame,
    turns: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Spans of every recording with times and, if turns are given, speakers."""
    texts = analyze(tr.transcript_text(transcripts), **options)
    spans = explode_spans(texts, KEY)
    timed = tr.span_times(spans, tr.word_intervals(transcripts, KEY), [KEY])
    if turns is None:
        return timed.withColumn("speaker_id", F.lit(None).cast("string"))
    return tr.span_speakers(timed, tr.clean_turns(turns), [KEY])


def masked_transcripts(
    transcripts: DataFrame, policy: Iterable[Policy] = (), **options
) -> DataFrame:
    """Full text, masked text and language per recording."""
    texts = anonymize(analyze(tr.transcript_text(transcripts), **options), policy)
    return texts.select(KEY, "text", "redacted_text", "items", "error", "language")


def cut_list(spans: DataFrame, recordings: DataFrame) -> DataFrame:
    """Merged sample ranges to overwrite; ``recordings`` has the number of samples of each.

    Recordings without a length keep their cuts, unclamped. Spans without times are not
    among them: take ``operators.transcript.beep_rejects`` of the same spans.
    """
    lengths = recordings.select(KEY, "n_samples")
    return tr.beep_islands(tr.beep_edits(spans.join(lengths, KEY, "left")), KEY)
