"""Segmentation."""

import random

import pytest

from veilspan.operators.segment import explode_segments, register_segmenter, scan_segments, segment, segment_with
from veilspan.operators.rules import Rule


def cut(df, strategy, **options):
    rows = explode_segments(segment(df, strategy, **options), "doc_id").orderBy("doc_id", "seg_no")
    return [(r.doc_id, r.segment_id, r.start, r.end, r.text) for r in rows.collect()]


def test_sentences(texts):
    got = cut(texts("1.5 a。b! tail", " \n ", None), "sentence", post_process=False)
    assert [g[2:] for g in got] == [(0, 2, "1."), (2, 6, "5 a。"), (6, 8, "b!"), (8, 13, " tail")]
    assert [g[1] for g in got] == ["seg_0000", "seg_0001", "seg_0002", "seg_0003"]
    assert [g[4] for g in cut(texts("ab. abcdef."), "sentence", min_length=5)] == ["abcdef."]


def test_strip_moves_offsets(texts):
    assert cut(texts("　a b.  c! \t"), "sentence") == [
        (0, "seg_0000", 1, 5, "a b."), (0, "seg_0001", 7, 9, "c!")]


def test_paragraphs(texts):
    text = "first paragraph\n\nshort\r\n\r\nanother paragraph\n\n\n\nlast one is here"
    got = cut(texts(text), "paragraph")
    assert [g[4] for g in got] == ["first paragraph", "short", "another paragraph", "last one is here"]
    bounded = segment(texts(text), "paragraph", min_length=10).first()
    assert [s.text for s in bounded.segments] == ["first paragraph", "another paragraph", "last one is here"]
    assert [s.text for s in bounded.outside] == ["short"]
    assert all(text[g[2] : g[3]] == g[4] for g in got)


def test_windows(texts):
    got = cut(texts("x" * 1000, "x" * 500, "x" * 501, "x"), "fixed_length", respect_word_boundaries=False)
    assert [(g[0], g[2], g[3]) for g in got] == [
        (0, 0, 500), (0, 450, 950), (0, 900, 1000), (1, 0, 500), (2, 0, 500), (2, 450, 501), (3, 0, 1)]
    with pytest.raises(ValueError):
        cut(texts("x"), "fixed_length", size=5, overlap=5)


def word_windows(text, size, overlap):
    out, pos = [], 0
    while True:
        end = min(pos + size, len(text))
        if end < len(text):
            spaces = [i for i in range(end - pos) if text[pos + i].isspace()]
            if spaces and spaces[-1] > overlap:
                end = pos + spaces[-1]
        if text[pos:end].strip():
            out.append((pos, end))
        if end == len(text):
            return out
        pos = end - overlap


def test_word_windows_equal_loop(texts):
    rng = random.Random(5)
    values = ["".join(rng.choice("ab  \n") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    # White space in the one place where windows move on by a single step.
    values += ["a" * 6 + (" " + "b" * 4) * 30, ("a" * 6 + " ") * 40, "x" * 200]
    df = texts(*[v for v in values if v.strip()])
    got = {}
    for key, _, start, end, _ in cut(df, "fixed_length", size=10, overlap=5, post_process=False):
        got.setdefault(key, []).append((start, end))
    for key, value in enumerate(v for v in values if v.strip()):
        assert got[key] == word_windows(value, 10, 5)


def test_custom_patterns_and_whole(texts):
    text = "a--b;c--d"
    got = cut(texts(text), "custom", patterns=["--", ";"])
    assert [g[2:] for g in got] == [
        (0, 1, "a"), (3, 6, "b;c"), (8, 9, "d"), (0, 4, "a--b"), (5, 9, "c--d")]
    for strategy in ("custom", "whole"):
        assert [g[2:] for g in cut(texts(text), strategy)] == [(0, 9, text)]
    assert cut(texts("a. b."), "no such strategy") == cut(texts("a. b."), "sentence")


def test_function(texts):
    def halves(text):
        if text.startswith("!"):
            raise RuntimeError("no")
        middle = len(text) // 2
        return [(0, middle, text[:middle]), (middle, len(text), text[middle:])]

    rows = segment_with(texts("abcd", "!xy", " ", None), halves).orderBy("doc_id", "seg_no").collect()
    assert [(r.doc_id, r.seg_no, r.segment_id, r.start, r.end, r.text) for r in rows] == [
        (0, 0, "seg_0000", 0, 2, "ab"), (0, 1, "seg_0001", 2, 4, "cd"), (1, 0, "seg_0000", 0, 3, "!xy")]


def test_spans_found_in_overlapping_segments_count_once(texts):
    rule = Rule("N", "n", "[0-9]{3}", 0.5)
    text = "x" * 6 + "123" + "x" * 20
    df = segment(texts(text), "fixed_length", size=10, overlap=6, respect_word_boundaries=False)
    spans = scan_segments(df, [rule]).first().spans
    assert [(s.start, s.end, s.value) for s in spans] == [(6, 9, "123")]


def test_table_function_rows_travel_a_few_at_a_time(spark):
    """Not in Arrow batches, which hold thousands of texts of any length."""
    register_segmenter(spark, "in_twos", lambda t: [(i, i + 2, t[i : i + 2]) for i in range(0, len(t), 2)])
    cut = spark.sql("SELECT d.id, s.* FROM VALUES (1, 'abcd'), (2, ' '), (3, NULL) AS d(id, t), LATERAL in_twos(d.t) AS s")
    assert [tuple(r) for r in cut.collect()] == [(1, 0, "seg_0000", 0, 2, "ab", None), (1, 1, "seg_0001", 2, 4, "cd", None)]
    assert "BatchEvalPythonUDTF" in cut._jdf.queryExecution().toString() and "ArrowEval" not in cut._jdf.queryExecution().toString()
