"""Texts and sequences too long for one row or one window."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilspan.operators import segment as sg
from veilspan.operators.offsets import flat_word_places, running_offsets
from veilspan.operators.redact import Policy, redact
from veilspan.operators.resolve import resolve
from veilspan.operators.rules import Rule
from veilspan.operators.scan import scan

NUMBER = Rule("NUMBER", "number", "[0-9]+", 0.5)


@pytest.mark.parametrize("width", [2, 5, 64])
def test_running_offsets(spark, width):
    draw = random.Random(width)
    rows, expected = [], {}
    for key in (None, "a", "b"):
        places, total = sorted(draw.sample(range(300), 120)), 0
        for n in places:
            size = draw.choice([None, 0, 1, 7, 10**10])
            rows.append((key, n, size))
            expected[key, n] = total
            total += size or 0
    draw.shuffle(rows)
    df = running_offsets(spark.createDataFrame(rows, "k string, n int, size long"), ["k"], "n", "size", width=width)
    assert df.columns == ["k", "n", "size", "offset"]
    assert {(r.k, r.n): r.offset for r in df.collect()} == expected


def test_no_window_over_a_whole_sequence(spark):
    df = running_offsets(spark.range(10).selectExpr("1 AS k", "id AS n", "id AS size"), ["k"], "n", "size")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    assert windows and all(re.search(r"__b#\d+L?, (n|__b)|__s#\d+L?, __b", w) for w in windows)


def test_flat_words(spark):
    words = spark.createDataFrame(
        [("r", 0, "ab", 2), ("r", 1, "😀", 1), ("r", 2, None, 1), ("r", 3, "c", 0), (None, 0, "x", None)],
        "rec string, word_no int, word string, before int",
    )
    got = {(r.rec, r.word_no): (r.c0, r.c1) for r in flat_word_places(words, ["rec"], width=2).collect()}
    assert got == {("r", 0): (2, 4), ("r", 1): (5, 6), ("r", 2): (None, None), ("r", 3): (7, 8), (None, 0): (0, 1)}


def rows_of(spark, texts, **options):
    df = spark.createDataFrame([(k, t) for k, t in texts], "doc_id long, text string")
    return sg.segment_rows(sg.segment(df, **options), "doc_id")


ODD = [" a. b!  c 1 \n", "", "   ", ".", "no end", "x。y？　z\t", "😀. 京 2!", "a.b.c." * 300, "\n\nA 12. B\n"]


@pytest.mark.parametrize("options", [
    {}, {"strategy": "paragraph", "separators": ["\n"]}, {"strategy": "whole"}, {"min_length": 3, "max_length": 6},
    {"strategy": "fixed_length", "size": 7, "overlap": 0, "respect_word_boundaries": False}, {"post_process": False},
])
def test_nothing_masked_nothing_changed(spark, monkeypatch, options):
    """Byte by byte, for null and repeated keys, whole and in parts."""
    monkeypatch.setattr(sg, "STRETCH", 4)
    texts = [(k, t) for t in ODD for k in (None, 1, 1)]
    rows = rows_of(spark, texts, **options)
    assert rows.filter("lead RLIKE '[a-z0-9]'").count() == 0
    back = sg.merge_segments_long(rows, "doc_id", text_col="text").collect()
    assert sorted(((r.doc_id, r.redacted_text) for r in back), key=repr) == sorted(texts, key=repr)
    parts = {}
    for r in sg.merge_segments_parts(rows, "doc_id", text_col="text").orderBy("text_no", "part_no").collect():
        assert r.start == len(parts.get(r.text_no, "")) and r.error is None
        parts[r.text_no] = parts.get(r.text_no, "") + r.redacted_text
    assert sorted(parts.values()) == sorted(t for _, t in texts)


def test_masked_rows(spark):
    rows = resolve(scan(rows_of(spark, [(1, " a 1. b 22!\n"), (None, "3")]), [NUMBER]), "cover")
    back = sg.merge_segments_long(redact(rows, [Policy(new_value="[N]")]).drop("error"), "doc_id")
    assert sorted(((r.doc_id, r.redacted_text, r.error) for r in back.collect()), key=repr) == [
        (1, " a [N]. b [N]!\n", None), (None, "[N]", None),
    ]


def test_errors_take_the_whole_text(spark):
    rows = rows_of(spark, [(1, "a. b. c."), (2, "d. e."), (3, "f."), (4, None)])
    lost = rows.withColumn("text", F.when(~((F.col("doc_id") == 1) & (F.col("seg_no") == 1)), F.col("text")))
    lost = lost.filter("NOT (doc_id = 2 AND seg_no = 1)")
    twice = lost.unionByName(lost.filter("doc_id = 3 AND seg_no = 0"))
    back = {r.doc_id: (r.redacted_text, r.error) for r in sg.merge_segments_long(twice, "doc_id", text_col="text").collect()}
    assert back == {
        1: (None, "a segment has no text"), 2: (None, "segments are missing or stand twice"),
        3: (None, "segments are missing or stand twice"), 4: (None, "a segment has no text"),
    }
    parts = sg.merge_segments_parts(twice, "doc_id", text_col="text").collect()
    assert all(p.redacted_text is None and p.error for p in parts)


def test_overlaps_are_refused(spark):
    rows = rows_of(spark, [(1, "abcdefghij" * 3)], strategy="fixed_length", size=10, overlap=3, respect_word_boundaries=False)
    assert [tuple(r) for r in sg.merge_segments_long(rows, "doc_id", text_col="text").drop("text_no").collect()] == [
        (1, None, "a segment has no text")
    ]
    assert sg.merge_segments_long(rows.filter("false"), "doc_id", text_col="text").count() == 0


def test_work_grows_with_the_segments(spark):
    """Nothing is worked out for all segments of a text once for each of them, and rows are grouped once."""
    text = "ab. " * 12_000
    began = time.monotonic()
    rows = rows_of(spark, [(1, text)])
    generate = re.search(r"Generate .*", rows._jdf.queryExecution().optimizedPlan().toString())[0]
    assert re.search(r"inline\(__rows#\d+\), \[\d+\]", generate)  # the array itself stays behind
    back = sg.merge_segments_long(rows, "doc_id", text_col="text")
    assert [(r.redacted_text, r.error) for r in back.collect()] == [(text, None)]
    assert time.monotonic() - began < 30
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "distinct count" not in plan and "count(distinct" not in plan
