"""Words, times, speakers, cut lists, boxes."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.operators import boxes
from veilspan.operators import transcript as tr

W = "struct<word:string,start:double,end:double,score:double>"
SCHEMA = f"audio_id string, segments array<struct<start:double,end:double,text:string,words:array<{W}>>>, language string"


@pytest.fixture(scope="module")
def recordings(spark):
    hello = [("call", 0.0, 0.4, 0.9), ("13812", 1.0, 2.0, 0.8), ("gone", 2.0, 2.1, 0.5), ("345678", 2.5, 3.1, 0.7)]
    segs = [
        (0.0, 3.2, " call 13812 345678!", hello),
        (4.0, 6.0, "no words", None),
        (7.0, 9.0, "half timed", [("half", None, None, None), ("timed", 8.0, 9.0, 0.5)]),
    ]
    return spark.createDataFrame([("a", segs, "en"), ("b", [], None)], SCHEMA)


def test_text_and_words(recordings):
    texts = {r.audio_id: r.text for r in tr.transcript_text(recordings).collect()}
    assert texts == {"a": " call 13812 345678! no words half timed", "b": ""}
    words = tr.flatten_words(recordings, "audio_id").orderBy("seg_no", "word_no").collect()
    assert [w.word for w in words] == ["call", "13812", "gone", "345678", "half", "timed"]


def test_intervals(recordings):
    rows = tr.word_intervals(recordings, "audio_id").orderBy("c0").collect()
    got = [(r.c0, r.c1, r.word, r.t0, r.t1) for r in rows]
    assert got == [
        (0, 1, None, 0.0, 0.0), (1, 5, "call", 0.0, 0.4), (5, 6, None, 1.0, 1.0), (6, 11, "13812", 1.0, 2.0),
        (11, 12, None, 2.5, 2.5), (12, 18, "345678", 2.5, 3.1), (18, 19, None, 3.1, 3.1), (19, 20, None, 3.2, 3.2),
        (20, 28, None, 4.0, 6.0), (28, 29, None, 6.0, 6.0), (29, 39, None, 7.0, 9.0),
    ]


def plain_words(text, words):
    pos, out = 0, []
    for word in words:
        at = text.find(word, pos) if word else -1
        if at >= 0:
            out.append((at, at + len(word), word))
            pos = at + len(word)
    return out


@pytest.mark.parametrize("ahead", [4, 16, 2048])
def test_words_anywhere(spark, monkeypatch, ahead):
    """Words near by, far off, longer than what is looked ahead, missing, and letters of several bytes."""
    monkeypatch.setattr(tr, "AHEAD", ahead)
    draw = random.Random(ahead)
    rows = []
    for i in range(40):
        parts = [draw.choice(["ab", "é", "😀京", "word", "averylongword" * 3, "x"]) for _ in range(60)]
        text = "".join(p + draw.choice([" ", "  ", "", "\n"]) for p in parts)
        words = [w for w in parts if draw.random() < 0.6] + ["gone"] * (i % 3)
        draw.random() < 0.3 and draw.shuffle(words)
        rows.append((str(i), [(0.0, 9.0, text, [(w, 1.0, 2.0, 0.5) for w in words])], "en"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in tr.word_intervals(df, "audio_id").filter("word IS NOT NULL").orderBy("c0").collect():
        got.setdefault(r.audio_id, []).append((r.c0, r.c1, r.word))
    assert got == {a: plain_words(s[0][2], [w[0] for w in s[0][3]]) for a, s, _ in rows}


SPANS = "audio_id string, start int, end int, entity_type string, pattern string, value string"


@pytest.mark.parametrize("width", [2, 512])
def test_times(spark, recordings, width):
    """Whatever the stretch of text by which spans and words meet."""
    spans = spark.createDataFrame(
        [("a", 6, 18, "P", "whole", "v"), ("a", 7, 9, "P", "inside", "v"), ("a", 5, 7, "P", "gap", "v"),
         ("a", 20, 22, "P", "no words", "v"), ("a", 100, 110, "P", "outside", "v"), ("z", 0, 1, "P", "unknown", "v")],
        SPANS)
    rows = tr.span_times(spans, tr.word_intervals(recordings, "audio_id"), ["audio_id"], width=width).collect()
    got = {r.pattern: (r.start_time, r.end_time) for r in rows}
    assert got == {
        "whole": (1.0, 3.1), "inside": (1.2, 1.6), "gap": (1.0, 2.0), "no words": (4.0, 6.0),
        "outside": (None, None), "unknown": (None, None),
    }
    plain = tr.span_times(spans, tr.word_intervals(recordings, "audio_id"), ["audio_id"], interpolate=False)
    assert {r.pattern: (r.start_time, r.end_time) for r in plain.collect()}["inside"] == (1.0, 2.0)


TURNS = "audio_id string, speaker_id string, start_time double, end_time double"


def test_speakers(spark):
    spans = spark.createDataFrame(
        [("a", 0, 1, "P", "first wins", "v", 4.0, 6.0), ("a", 1, 2, "P", "border", "v", 119.0, 121.0),
         ("a", 2, 3, "P", "nobody", "v", 500.0, 501.0), ("b", 0, 1, "P", "other", "v", 1.0, 2.0),
         ("a", 3, 4, "P", "no time", "v", None, None)],
        SPANS + ", start_time double, end_time double")
    turns = spark.createDataFrame(
        [("a", "s2", 3.0, 10.0), ("a", "s1", 2.0, 7.0), ("a", "s3", 60.0, 120.0), ("a", "s4", 200.0, 200.5)], TURNS)
    rows = tr.by_speaker(tr.span_speakers(spans, tr.clean_turns(turns), ["audio_id"])).collect()
    assert {r.pattern: r.speaker_id for r in rows} == {
        "first wins": "s1", "border": "s3", "nobody": "unknown", "other": "unknown", "no time": "unknown"}


def test_turn_figures(spark):
    turns = spark.createDataFrame(
        [("a", "x", 0.0, 4.0), ("a", "y", 3.0, 6.0), ("a", "x", 5.0, 70.0), ("a", "x", 60.0, 65.0), ("b", "x", 0.0, 0.5)],
        TURNS)
    assert tr.clean_turns(turns).count() == 4
    stats = {(r.audio_id, r.speaker_id): (r.n_turns, r.speaking_time) for r in tr.speaker_stats(turns, "audio_id").collect()}
    assert stats[("a", "x")] == (3, 74.0)
    rec = {r.audio_id: (r.speaker_count, r.total_duration) for r in tr.recording_stats(turns, "audio_id").collect()}
    assert rec == {"a": (2, 70.0), "b": (1, 0.5)}
    over = {r.audio_id: r.overlap_time for r in tr.overlapped_speech(turns, "audio_id", width=8.0).collect()}
    assert over == {"a": 2.0, "b": 0.0}  # two turns of one speaker are no overlap
    line = tr.speaker_timeline(turns.filter("audio_id = 'a'"), "audio_id").collect()
    assert [(r.speaker_id, r.start_time) for r in line] == [("x", 0.0), ("x", 5.0), ("x", 60.0), ("y", 3.0)]


@pytest.mark.parametrize("width", [5, 64])
def test_merged_intervals_equal_loop(spark, width):
    """Most rows belong to one key; intervals cross and touch borders."""
    rng = random.Random(width)
    rows = []
    for _ in range(600):
        lo = rng.randrange(3000)
        rows.append(("hot" if rng.random() < 0.8 else rng.choice("ab"), lo, lo + rng.randrange(1, 15)))
    df = spark.createDataFrame(rows, "k string, lo int, hi int")
    got = sorted(tuple(r) for r in tr.merge_intervals(df, ["k"], "lo", "hi", width).select("k", "lo", "hi", "n").collect())
    want = []
    for key, lo, hi in sorted(rows):
        if want and want[-1][0] == key and lo <= want[-1][2]:
            want[-1][2], want[-1][3] = max(want[-1][2], hi), want[-1][3] + 1
        else:
            want.append([key, lo, hi, 1])
    assert got == sorted(tuple(w) for w in want)


def test_beeps(spark):
    spans = spark.createDataFrame([("a", 1.573, 5.88), ("a", 9.0, 20.0), ("a", 11.0, 12.0), ("a", -1.0, 0.001)],
                                  "audio_id string, start_time double, end_time double")
    edits = tr.beep_edits(spans.withColumn("n_samples", F.lit(220_500)))
    got = [(r.start_sample, r.end_sample) for r in edits.orderBy("start_sample").collect()]
    assert got == [(0, 22), (34684, 129654), (198450, 220500)]
    assert tr.beep_islands(edits, "audio_id").count() == 3


def test_clips(spark):
    segs = spark.createDataFrame(
        [(0, 0.5, 3.0, "hi...", [0.5, 0.7]), (1, 0.05, 1.0, "short", []), (2, 10.0, 12.0, "x", [1.0])],
        "seg_no int, start double, end double, text string, word_scores array<double>")
    rows = tr.segment_quality(segs, F.lit(11_000)).orderBy("seg_no").collect()
    assert [(r.from_ms, r.to_ms, r.text, round(r.confidence, 3), r.keep) for r in rows] == [
        (500, 3080, "hi", 0.6, True), (0, 1080, "short", 0.0, False), (9920, 11000, "x", 1.0, False)]
    parts = tr.resplit_equal(spark.createDataFrame([("a", 25.0), ("b", 4.0), ("c", 35.0)], "k string, duration double"), "k")
    got = {}
    for r in parts.orderBy("k", "part_no").collect():
        got.setdefault(r.k, []).append((r.start_time, r.end_time))
    assert got == {"a": [(0.0, 12.5), (12.5, 25.0)], "c": [(0.0, 8.75), (8.75, 17.5), (17.5, 26.25), (26.25, 35.0)]}


@pytest.mark.parametrize("width", [3, 512])
def test_boxes(spark, width):
    box = "struct<word_no:int,text:string,left:int,top:int,width:int,height:int,conf:double>"
    words = [(i, w, i * 10, 0, 8, 5, 0.9) for i, w in enumerate(["my", "card", "4111 1111", "end"])]
    pages = boxes.page_text(spark.createDataFrame([(1, words), (2, words[:1])], f"image_id int, words array<{box}>"))
    assert pages.filter("image_id = 1").first().text == "my card 4111 1111 end"
    spans = spark.createDataFrame([(1, "A", 4, 12), (1, "B", 8, 17), (1, "C", 2, 3)], "image_id int, entity_type string, start int, end int")
    got = boxes.covered_boxes(spans, boxes.explode_words(pages, "image_id"), ["image_id"], width)
    want = [("A", 1, 10), ("A", 2, 20), ("B", 2, 20)]
    assert sorted((r.entity_type, r.word_no, r.left) for r in got.collect()) == want
    grouped = spans.groupBy("image_id").agg(F.collect_list(F.struct("entity_type", "start", "end")).alias("spans"))
    on_row = boxes.page_boxes(pages.join(grouped, "image_id", "left"), "image_id")
    assert sorted((r.entity_type, r.word_no, r.left) for r in on_row.collect()) == want
