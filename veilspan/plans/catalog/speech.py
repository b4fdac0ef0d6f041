"""Transcripts, speakers, cut lists, word boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import boxes, metrics
from ...operators import transcript as tr
from ...operators.offsets import flat_word_places
from ...operators.resolve import resolve
from ...operators.scan import explode_spans, scan
from ...operators.steps import new_path
from ...sources.rttm import read_rttm, write_rttm
from . import sqltext as q
from .detection import all_checked, strict
from .inputs import SPEECH_RULES, SPEECH_SQL, WORD, documents, speaker_turns, turn_segments
from .registry import query

KEYS = ["conv_id", "turn"]
SPAN_KEYS = ["turn", "start", "end", "entity_type", "pattern"]


@query("transcript_words", q.with_query(
    [SPEECH_SQL], "SELECT conv_id, turn, word_no, word, c0, CAST(c0 + length(word) AS INTEGER) AS c1, "
    "round(t0, 6) AS t0, round(t1, 6) AS t1 FROM words"))
def transcript_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every turn located in its text."""
    placed = tr.word_intervals(turn_segments(spark, sf_dir), *KEYS).filter("word IS NOT NULL")
    return placed.select(
        *KEYS, "word_no", "word", "c0", "c1",
        F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"),
    )


@query("words_flat_offsets", q.with_query(
    [SPEECH_SQL], "SELECT conv_id, turn, word_no, word, CAST(c0 AS BIGINT) AS c0, "
    "CAST(c0 + length(word) AS BIGINT) AS c1, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM words"))
def words_flat_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same places from a flat table of words and gaps, in buckets of sixteen words."""
    gaps = F.transform(F.split("text", WORD, -1), F.length)
    flat = turn_segments(spark, sf_dir).select(
        *KEYS, gaps.alias("gaps"), F.posexplode(F.col("segments")[0]["words"]).alias("word_no", "w")
    )
    words = flat.select(
        *KEYS, "word_no", F.col("w.word").alias("word"), F.get("gaps", "word_no").alias("before"),
        F.round("w.start", 6).alias("t0"), F.round("w.end", 6).alias("t1"),
    )
    return flat_word_places(words, KEYS, width=16).drop("before")


TEXTS = "texts AS (SELECT conv_id, turn, text FROM turns)"
HITS = [SPEECH_SQL, TEXTS, q.hits("h", "texts", SPEECH_RULES, "conv_id, turn")]
TIMES = [
    *HITS,
    """ends AS (
  SELECT h.conv_id, h.turn, h.entity_type, h.pattern, h."start", h."end", h.value,
    arg_min(w.t0, w.c0) FILTER (w.c0 + length(w.word) > h."start") AS a_t0,
    min(w.c0) FILTER (w.c0 + length(w.word) > h."start") AS a_c0,
    arg_min(w.t1, w.c0) FILTER (w.c0 + length(w.word) > h."start") AS a_t1,
    arg_min(w.word, w.c0) FILTER (w.c0 + length(w.word) > h."start") AS a_word,
    arg_min(w.t1, w.c0) FILTER (w.c0 + length(w.word) > h."end" - 1) AS b_t1,
    min(w.c0) FILTER (w.c0 + length(w.word) > h."end" - 1) AS b_c0
  FROM h JOIN words w ON w.conv_id = h.conv_id AND w.turn = h.turn GROUP BY ALL
),
timed AS (
  SELECT conv_id, turn, entity_type, pattern, "start", "end", value,
    a_t0 AS plain_start, b_t1 AS plain_end,
    CASE WHEN a_c0 = b_c0 AND "start" >= a_c0
      THEN a_t0 + ("start" - a_c0) * ((a_t1 - a_t0) / length(a_word)) ELSE a_t0 END AS start_time,
    CASE WHEN a_c0 = b_c0 AND "start" >= a_c0
      THEN a_t0 + ("end" - a_c0) * ((a_t1 - a_t0) / length(a_word)) ELSE b_t1 END AS end_time
  FROM ends
)""",
]


def timed_spans(spark: SparkSession, sf_dir: str, interpolate: bool = True) -> DataFrame:
    found = scan(turn_segments(spark, sf_dir), SPEECH_RULES)
    return tr.row_span_times(found, *KEYS, interpolate=interpolate)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *KEYS, "entity_type", "pattern", "start", "end", "value",
        F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"),
    )


@query("span_to_time", q.with_query(
    TIMES, 'SELECT conv_id, turn, entity_type, pattern, "start", "end", value, '
    "round(plain_start, 6) AS start_time, round(plain_end, 6) AS end_time FROM timed"))
def span_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timed_spans(spark, sf_dir, interpolate=False))


@query("span_time_join", q.with_query(
    TIMES, 'SELECT conv_id, turn, entity_type, pattern, "start", "end", value, '
    "round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM timed"))
def span_time_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of spans and a table of words."""
    turns = turn_segments(spark, sf_dir)
    spans = explode_spans(scan(turns, SPEECH_RULES), *KEYS).select(
        *KEYS, "entity_type", "pattern", "start", "end", "value"
    )
    return _rounded(tr.span_times(spans, tr.word_intervals(turns, *KEYS), KEYS))


@query("span_interp_time", q.with_query(
    TIMES, 'SELECT conv_id, turn, entity_type, pattern, "start", "end", value, '
    "round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM timed"))
def span_interp_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timed_spans(spark, sf_dir))


MIN_TURN = 1.0
SPEAKERS = [
    *TIMES,
    f"long_turns AS (SELECT * FROM speaker_turns WHERE end_time - start_time >= {MIN_TURN})",
    """spoken AS (
  SELECT t.conv_id, t.turn, t.entity_type, t.pattern, t."start", t."end", t.start_time, t.end_time,
    arg_min(s.speaker_id, s.start_time) AS speaker_id
  FROM timed t LEFT JOIN long_turns s ON s.conv_id = t.conv_id
    AND (t.start_time + t.end_time) / 2 BETWEEN s.start_time AND s.end_time
  GROUP BY ALL
)""",
]


def spoken_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tr.clean_turns(speaker_turns(spark, sf_dir).drop("turn"), MIN_TURN)
    return tr.span_speakers(timed_spans(spark, sf_dir), turns, ["conv_id"], SPAN_KEYS)


@query("span_to_speaker", q.with_query(
    SPEAKERS, 'SELECT conv_id, turn, entity_type, pattern, "start", "end", speaker_id FROM spoken'))
def span_to_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers come from turns of a second or more: spans in shorter ones may have none."""
    return spoken_spans(spark, sf_dir).select(*KEYS, "entity_type", "pattern", "start", "end", "speaker_id")


@query("spans_by_speaker", q.with_query(
    SPEAKERS, """SELECT conv_id, coalesce(speaker_id, 'unknown') AS speaker_id, entity_type,
      count(*) AS n, round(min(start_time), 6) AS first_time, round(max(end_time), 6) AS last_time
    FROM spoken GROUP BY ALL"""))
def spans_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.by_speaker(spoken_spans(spark, sf_dir)).groupBy(
        "conv_id", "speaker_id", "entity_type"
    ).agg(
        F.count("*").alias("n"),
        F.round(F.min("start_time"), 6).alias("first_time"),
        F.round(F.max("end_time"), 6).alias("last_time"),
    )


@query("turn_cleanup", q.with_query(
    SPEAKERS, "SELECT conv_id, turn, speaker_id, round(start_time, 6) AS start_time, "
    "round(end_time, 6) AS end_time FROM long_turns"))
def turn_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.clean_turns(speaker_turns(spark, sf_dir), MIN_TURN).select(
        *KEYS, "speaker_id",
        F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"),
    )


@query("speaker_stats", q.with_query(
    [SPEECH_SQL], """SELECT conv_id, speaker_id, count(*) AS n_turns,
      round(sum(end_time - start_time), 4) AS speaking_time FROM speaker_turns GROUP BY ALL"""))
def speaker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = tr.speaker_stats(speaker_turns(spark, sf_dir), "conv_id")
    return stats.withColumn("speaking_time", F.round("speaking_time", 4))


@query("recording_stats", q.with_query(
    [SPEECH_SQL], """SELECT conv_id, count(DISTINCT speaker_id) AS speaker_count,
      round(max(end_time), 6) AS total_duration FROM speaker_turns GROUP BY conv_id"""))
def recording_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = tr.recording_stats(speaker_turns(spark, sf_dir), "conv_id")
    return stats.withColumn("total_duration", F.round("total_duration", 6))


@query("speaker_timeline", q.with_query(
    [SPEECH_SQL], """SELECT conv_id, speaker_id, round(start_time, 6) AS start_time,
      round(end_time, 6) AS end_time FROM speaker_turns ORDER BY ALL"""))
def speaker_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = speaker_turns(spark, sf_dir).select(
        "conv_id", "speaker_id",
        F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"),
    )
    return tr.speaker_timeline(rounded, "conv_id")


@query("overlapped_speech", q.with_query(
    [SPEECH_SQL,
     "marks AS (SELECT conv_id, start_time AS t FROM speaker_turns UNION SELECT conv_id, end_time FROM speaker_turns)",
     "pieces AS (SELECT conv_id, t AS a, lead(t) OVER (PARTITION BY conv_id ORDER BY t) AS b FROM marks)",
     """talk AS (SELECT p.conv_id, a, b, count(DISTINCT s.speaker_id) AS k FROM pieces p
       JOIN speaker_turns s ON s.conv_id = p.conv_id AND s.start_time <= p.a AND s.end_time >= p.b
       WHERE b IS NOT NULL GROUP BY ALL)"""],
    """SELECT conv_id, round(coalesce(sum(b - a) FILTER (k >= 2), 0), 4) AS overlap_time
    FROM talk GROUP BY conv_id"""))
def overlapped_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = tr.overlapped_speech(speaker_turns(spark, sf_dir), "conv_id")
    return both.withColumn("overlap_time", F.round("overlap_time", 4))


# --- recordings of several segments: eight turns of a conversation each, some without word times

TURNS = 8
RECORDING_SQL = [
    SPEECH_SQL,
    f"""rec AS (SELECT conv_id, turn // {TURNS} AS part, turn, text, t_turn,
  CAST(row_number() OVER (PARTITION BY conv_id, turn // {TURNS} ORDER BY turn) - 1 AS INTEGER) AS seg_no FROM turns)""",
]


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested transcripts; every third turn has words without times."""
    seg = F.col("segments")[0]
    untimed = F.transform(
        seg["words"],
        lambda w: F.struct(
            w["word"].alias("word"), F.lit(None).cast("double").alias("start"),
            F.lit(None).cast("double").alias("end"), w["score"].alias("score"),
        ),
    )
    words = F.when(F.col("turn") % 3 == 1, untimed).otherwise(seg["words"])
    turns = turn_segments(spark, sf_dir).select(
        "conv_id", F.floor(F.col("turn") / TURNS).alias("part"), "turn",
        F.struct(seg["start"].alias("start"), seg["end"].alias("end"), seg["text"].alias("text"), words.alias("words")).alias("seg"),
    )
    nested = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "seg"))).alias("s"))
    return nested.select("conv_id", "part", F.transform("s", lambda x: x["seg"]).alias("segments"))


@query("transcript_text", q.with_query(
    RECORDING_SQL, "SELECT conv_id, part, string_agg(text, ' ' ORDER BY turn) AS text FROM rec GROUP BY conv_id, part"))
def transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.transcript_text(recordings(spark, sf_dir)).select("conv_id", "part", "text")


@query("flatten_words", q.with_query(
    RECORDING_SQL, """SELECT r.conv_id, r.part, r.seg_no, w.word_no, w.word,
      CASE WHEN r.turn % 3 <> 1 THEN round(w.t0, 6) END AS t0, CASE WHEN r.turn % 3 <> 1 THEN round(w.t1, 6) END AS t1
    FROM rec r JOIN words w ON w.conv_id = r.conv_id AND w.turn = r.turn"""))
def flatten_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tr.flatten_words(recordings(spark, sf_dir), "conv_id", "part")
    return flat.select(
        "conv_id", "part", "seg_no", "word_no", "word", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1")
    )


@query("word_gaps", q.with_query(
    [*RECORDING_SQL,
     """placed AS (SELECT r.*, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id, part ORDER BY turn
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM rec r)"""],
    """SELECT p.conv_id, p.part, CAST(p.c AS INTEGER) AS c0, CAST(p.c + length(p.text) AS INTEGER) AS c1,
      round(s.start_time, 6) AS t0, round(s.end_time, 6) AS t1
    FROM placed p JOIN speaker_turns s ON s.conv_id = p.conv_id AND s.turn = p.turn WHERE p.turn % 3 = 1"""))
def word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without word times, placed in the recording's text with the segment's own times."""
    whole = tr.word_intervals(recordings(spark, sf_dir), "conv_id", "part")
    # such an interval names no word and, unlike a gap, lasts
    return whole.filter("word IS NULL AND t1 > t0").select(
        "conv_id", "part", "c0", "c1", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1")
    )


# --- cut lists: a recording is as long as its last turn -----------------------------

BEEPS = [
    *TIMES,
    f"""lengths AS (SELECT conv_id, CAST(trunc(round(max(end_time), 9) * {tr.SAMPLE_RATE}) AS BIGINT) AS n_samples
    FROM speaker_turns GROUP BY conv_id)""",
    f"""beeps AS (SELECT * FROM (SELECT conv_id, turn, entity_type, pattern, "start", "end",
    greatest(0, CAST(trunc(round(start_time, 9) * {tr.SAMPLE_RATE}) AS BIGINT)) AS start_sample,
    least(n_samples, CAST(trunc(round(end_time, 9) * {tr.SAMPLE_RATE}) AS BIGINT)) AS end_sample
    FROM timed JOIN lengths USING (conv_id)) WHERE start_sample < end_sample)""",
]


def recording_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every conversation, from its own turns."""
    last = F.round(F.max("end_time"), 9)
    return speaker_turns(spark, sf_dir).groupBy("conv_id").agg(
        (last * tr.SAMPLE_RATE).cast("long").alias("n_samples")
    )


def _beeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Interpolated times differ in the last bit between engines: settle them first.
    timed = timed_spans(spark, sf_dir).withColumns(
        {
            "start_time": F.round("start_time", 9),
            "end_time": F.round("end_time", 9),
        }
    )
    return tr.beep_edits(timed.join(recording_lengths(spark, sf_dir), "conv_id", "left"))


@query("beep_edit_list", q.with_query(
    BEEPS, 'SELECT conv_id, turn, entity_type, pattern, "start", "end", start_sample, end_sample FROM beeps'))
def beep_edit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beeps(spark, sf_dir).select(
        *KEYS, "entity_type", "pattern", "start", "end", "start_sample", "end_sample"
    )


@query("beep_islands", q.with_query(
    [*BEEPS,
     """reached AS (SELECT *, max(end_sample) OVER (PARTITION BY conv_id ORDER BY start_sample, end_sample
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM beeps)""",
     """numbered AS (SELECT *, sum(CASE WHEN start_sample <= reach THEN 0 ELSE 1 END) OVER (
       PARTITION BY conv_id ORDER BY start_sample, end_sample ROWS UNBOUNDED PRECEDING) AS island FROM reached)"""],
    """SELECT conv_id, min(start_sample) AS start_sample, max(end_sample) AS end_sample, count(*) AS n
    FROM numbered GROUP BY conv_id, island"""))
def beep_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Short stretches, so that some islands do cross a border.
    return tr.beep_islands(_beeps(spark, sf_dir), "conv_id", seconds=5)


# --- clips for voice data -----------------------------------------------------------


@query("segment_qc", q.with_query(
    [SPEECH_SQL,
     "scored AS (SELECT conv_id, turn, avg((length(word) % 10) / CAST(10 AS DOUBLE)) AS confidence FROM words GROUP BY ALL)",
     """clips AS (SELECT s.conv_id, s.turn, s.speaker_id, replace(t.text, '...', '') AS text, k.confidence,
       CAST(trunc(greatest(0, CASE WHEN s.turn = 0 THEN s.start_time ELSE s.start_time - CAST(0.08 AS DOUBLE) END) * 1000) AS BIGINT) AS from_ms,
       CAST(trunc(s.end_time * 1000) AS BIGINT) + 80 AS to_ms
       FROM speaker_turns s JOIN turns t USING (conv_id, turn) JOIN scored k USING (conv_id, turn))"""],
    """SELECT conv_id, turn, from_ms, to_ms, round(confidence, 6) AS confidence,
      (to_ms - from_ms > 1500 AND to_ms - from_ms < 20000 AND length(text) >= 2 AND length(text) < 200) AS keep
    FROM clips"""))
def segment_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = turn_segments(spark, sf_dir).select(
        *KEYS, F.col("turn").alias("seg_no"), "text", F.col("segments")[0].alias("seg")
    )
    flat = segs.select(
        *KEYS, "seg_no", "text",
        F.col("seg.start").alias("start"), F.col("seg.end").alias("end"),
        F.transform("seg.words", lambda w: w.getField("score")).alias("word_scores"),
    )
    return tr.segment_quality(flat).select(
        *KEYS, "from_ms", "to_ms", F.round("confidence", 6).alias("confidence"), "keep"
    )


@query("resplit_equal", q.with_query(
    [SPEECH_SQL,
     "long AS (SELECT conv_id, turn, end_time - start_time AS d, CAST(round_even((end_time - start_time) / 10, 0) AS INTEGER) AS n FROM speaker_turns)",
     "parts AS (SELECT conv_id, turn, d, n, UNNEST(range(0, n)) AS part_no FROM long WHERE n > 0)"],
    """SELECT conv_id, turn, CAST(part_no AS INTEGER) AS part_no, round(part_no * (d / n), 6) AS start_time,
      round(CASE WHEN part_no = n - 1 THEN d ELSE (part_no + 1) * (d / n) END, 6) AS end_time FROM parts"""))
def resplit_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = speaker_turns(spark, sf_dir).select(
        *KEYS, (F.col("end_time") - F.col("start_time")).alias("duration")
    )
    return tr.resplit_equal(lengths, *KEYS).select(
        *KEYS, "part_no",
        F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"),
    )


@query("resplit_rejects", q.with_query(
    [SPEECH_SQL],
    """SELECT conv_id, turn, round(end_time - start_time, 6) AS duration, 'recording too short to split' AS error
    FROM speaker_turns WHERE round_even((end_time - start_time) / 10, 0) = 0"""))
def resplit_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = speaker_turns(spark, sf_dir).select(
        *KEYS, (F.col("end_time") - F.col("start_time")).alias("duration")
    )
    return tr.resplit_rejects(lengths, *KEYS).withColumn("duration", F.round("duration", 6))


@query("transcript_stats", q.with_query(
    [SPEECH_SQL], """SELECT conv_id, round(sum(end_time - start_time), 4) AS total_duration,
      count(*) AS n_segments, CAST(sum(n_chars) AS BIGINT) AS n_chars, 'unknown' AS language
    FROM speaker_turns GROUP BY conv_id"""))
def transcript_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = speaker_turns(spark, sf_dir).withColumn("language", F.lit(None).cast("string"))
    report = metrics.transcript_report(turns, "conv_id", n_chars=F.col("n_chars"))
    return report.withColumn("total_duration", F.round("total_duration", 4))


# --- word boxes: documents as pages with ten words to a line --------------------------

BOX_SQL = """
tokens AS (SELECT doc_id, regexp_extract_all(text, '[^ \\n]+') AS ws FROM documents),
pages0 AS (SELECT doc_id, array_to_string(ws, ' ') AS text, ws FROM tokens),
word_each AS (SELECT doc_id, UNNEST(range(1, len(ws) + 1)) AS i, ws FROM pages0),
boxes AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS word_no, ws[i] AS word,
  CAST(coalesce(list_sum([length(w) + 1 for w in ws[1:i-1]]), 0) AS INTEGER) AS c0 FROM word_each)"""


@query("ocr_boxes", q.with_query(
    [BOX_SQL, *all_checked("pages0"), q.covered("v", "d")],
    """SELECT v.doc_id, v.entity_type, v."start", v."end", b.word_no,
      CAST((b.word_no % 10) * 100 AS INTEGER) AS "left", CAST((b.word_no // 10) * 20 AS INTEGER) AS top,
      CAST(length(b.word) * 8 AS INTEGER) AS width, 16 AS height
    FROM v JOIN boxes b ON b.doc_id = v.doc_id AND b.c0 < v."end" AND b.c0 + length(b.word) > v."start" """))
def ocr_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        lambda w, i: F.struct(
            i.alias("word_no"), w.alias("text"),
            ((i % 10) * 100).alias("left"), (F.floor(i / 10).cast("int") * 20).alias("top"),
            (F.length(w) * 8).alias("width"), F.lit(16).alias("height"), F.lit(0.9).alias("conf"),
        ),
    )
    pages = boxes.page_text(documents(spark, sf_dir).select("doc_id", words.alias("words")))
    return boxes.page_boxes(resolve(scan(pages, strict()), "cover"), "doc_id")


@query("ocr_boxes_join", q.with_query(
    [BOX_SQL, *all_checked("pages0"), q.covered("v", "d")],
    """SELECT v.doc_id, v.entity_type, v."start", v."end", b.word_no
    FROM v JOIN boxes b ON b.doc_id = v.doc_id AND b.c0 < v."end" AND b.c0 + length(b.word) > v."start" """))
def ocr_boxes_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table of spans and a table of words."""
    words = F.transform(
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        lambda w, i: F.struct(
            i.alias("word_no"), w.alias("text"), i.alias("left"), i.alias("top"),
            i.alias("width"), i.alias("height"), F.lit(0.9).alias("conf"),
        ),
    )
    pages = boxes.page_text(documents(spark, sf_dir).select("doc_id", words.alias("words")))
    found = resolve(scan(pages, strict()), "cover")
    laid_out = boxes.explode_words(found, "doc_id", spans_col="spans")
    joined = boxes.covered_boxes(explode_spans(found, "doc_id"), laid_out, ["doc_id"])
    return joined.select("doc_id", "entity_type", "start", "end", "word_no")


@query("rttm_roundtrip", q.with_query(
    [SPEECH_SQL], """SELECT CAST(conv_id AS VARCHAR) AS audio_id, speaker_id, start_time, end_time,
      CAST(NULL AS VARCHAR) AS record, CAST(NULL AS VARCHAR) AS error FROM speaker_turns
    UNION ALL SELECT CAST(conv_id AS VARCHAR), NULL, NULL, NULL, 'SPEAKER ' || conv_id || ' 1 0.5', 'fewer than 9 fields'
    FROM speaker_turns WHERE turn = 0"""))
def rttm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as RTTM files and read again, in small parts, with bad lines among them."""
    turns, path = speaker_turns(spark, sf_dir), new_path(spark, "rttm")
    write_rttm(turns.withColumn("audio_id", F.col("conv_id").cast("string")), path)
    bad = turns.filter("turn = 0").select(F.concat(F.lit("SPEAKER "), F.col("conv_id"), F.lit(" 1 0.5")))
    bad.write.text(f"{path}/bad")
    return read_rttm(spark, path, part_bytes=1 << 14)
