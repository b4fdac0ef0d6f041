"""RTTM files, error rows of files, table functions, dictionaries, figures of a run, routed streams."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from veilspan.operators import metrics
from veilspan.operators.dictionary import _longest, scan_dictionary
from veilspan.operators.redact import Policy, redact
from veilspan.operators.resolve import resolve
from veilspan.operators.rules import Rule
from veilspan.operators.scan import scan
from veilspan.operators.segment import register_segmenter, segment_with
from veilspan.sources import readers, rttm
from veilspan.streaming import routing
from veilspan.streaming.masking import document_stream, mask_stream

NUMBER = Rule("NUMBER", "number", "[0-9]+", 0.5)
TURNS = "audio_id string, speaker_id string, start_time double, end_time double"


# --- RTTM -----------------------------------------------------------------------


def test_lines_keep_every_digit():
    draw = random.Random(1)
    for _ in range(2000):
        a = draw.uniform(0, 10 ** draw.randrange(-3, 7))
        b = a + draw.uniform(0, 10 ** draw.randrange(-6, 5))
        assert rttm.parse_line(rttm.format_line("r", "s", a, b)) == ("r", "s", a, b, None, None)


@pytest.mark.parametrize(("line", "error"), [
    ("SPEAKER r 1 x 1 <NA> <NA> s <NA>", "turn without readable times"), ("SPEAKER r 1", "fewer than 9 fields"), ("SPEAKER", "fewer than 9 fields"),
    ("SPEAKER r 1 1 -1 <NA> <NA> s <NA>", "turn with times out of range"), ("SPEAKER r 1 nan 1 <NA> <NA> s <NA>", "turn with times out of range"),
])
def test_bad_lines(line, error):
    row = rttm.parse_line(line)
    assert row[4:] == (line, error) and row[2] is None
    assert rttm.parse_line("SPKR-INFO r 1") is None and rttm.parse_line("  ") is None


def test_files_in_parts(spark, tmp_path):
    """Every line once, whatever the size of the parts."""
    turns = [(f"rec{i % 3}", f"s{'é' * (i % 5)}", float(i), i + 0.1) for i in range(200)]
    path = str(tmp_path / "turns")
    rttm.write_rttm(spark.createDataFrame(turns, TURNS).repartition(3), path)
    (tmp_path / "turns" / "more").mkdir()
    (tmp_path / "turns" / "more" / "hand.rttm").write_bytes(b"\n;; note\r\nSPEAKER x 1 1 2 <NA> <NA> y <NA> <NA>\r\nSPEAKER z")
    (tmp_path / "turns" / "_hidden").write_text("SPEAKER q")
    whole = sorted([*((*t, None, None) for t in turns), ("x", "y", 1.0, 3.0, None, None), ("z", None, None, None, "SPEAKER z", "fewer than 9 fields")], key=str)
    for size in (7, 100, 1 << 20):
        assert sorted((tuple(r) for r in rttm.read_rttm(spark, path, size).collect()), key=str) == whole
    rttm.write_rttm(spark.createDataFrame(turns[:5], TURNS), path, mode="overwrite")
    assert rttm.read_rttm(spark, path).filter("audio_id LIKE 'rec%'").count() == 5
    assert rttm.read_rttm(spark, str(tmp_path)).count() == 7
    with pytest.raises(Exception, match="missing"):
        rttm.read_rttm(spark, str(tmp_path / "missing")).count()


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "turns")
    good = [("r", "s", float(i), i + 1.0) for i in range(20)]
    rttm.write_rttm(spark.createDataFrame(good, TURNS), path)
    before = sorted(os.listdir(path))
    for bad in (("r", "two words", 0.0, 1.0), ("r", None, 0.0, 1.0), ("r", "s", 2.0, 1.0), ("r", "s", None, 1.0)):
        with pytest.raises(Exception):  # noqa: B017
            rttm.write_rttm(spark.createDataFrame([*good, bad], TURNS).repartition(4), path)
        assert sorted(os.listdir(path)) == before
    rttm.write_rttm(spark.createDataFrame([], TURNS), path)
    assert rttm.read_rttm(spark, path).count() == 20


# --- error rows -------------------------------------------------------------------


def test_response_errors(spark, tmp_path):
    file = tmp_path / "r.json"
    file.write_text('{"doc_id": 1, "raw_response": "x"}\n{"doc_id": 2}\n{"raw_response": "y"}\n{"doc_id": 3, "raw_re\n\n{}\n{"doc_id": 4, "raw_response": ""}\n')
    assert [tuple(r) for r in readers.read_responses(spark, str(file)).orderBy("doc_id").collect()] == [(1, "x"), (4, "")]
    bad = sorted((tuple(r) for r in readers.read_response_errors(spark, str(file)).collect()), key=str)
    assert bad == sorted([
        (2, None, "record without raw_response"), (None, None, "record without key"), (None, None, "record without key"),
        (None, '{"doc_id": 3, "raw_re', "unreadable record"),
    ], key=str)
    (tmp_path / "none.json").write_text("")
    assert readers.read_response_errors(spark, str(tmp_path / "none.json")).count() == 0
    spark.createDataFrame([(1, None), (2, "a")], "doc_id long, raw_response string").write.parquet(str(tmp_path / "p"))
    assert readers.read_responses(spark, str(tmp_path / "p"), "parquet").count() == 1
    assert readers.read_response_errors(spark, str(tmp_path / "p"), "parquet").first().error == "record without raw_response"


def test_ocr_errors(spark, tmp_path):
    word = {"word_no": 0, "text": "a", "left": 1, "top": 2, "width": 3, "height": 4, "conf": 0.5}
    pages = [{"image_id": 1, "words": [word]}, {"image_id": 2}, {"words": [word]}, {"image_id": 3, "words": [{**word, "left": None}]},
             {"image_id": 4, "words": []}, {"image_id": 5, "words": [None]}]
    file = tmp_path / "o.json"
    file.write_text("\n".join(map(json.dumps, pages)) + '\n{"image_id": 6, "words": "no"}\n')
    assert [r.image_id for r in readers.read_ocr_words(spark, str(file)).orderBy("image_id").collect()] == [1, 4]
    bad = {(r.image_id, r.error) for r in readers.read_ocr_errors(spark, str(file)).collect()}
    assert {(2, "record without words"), (None, "record without key"), (3, "word without text or box"), (5, "word without text or box")} < bad
    assert len(bad) == 5 and "unreadable record" in {e for _, e in bad}


# --- table functions ------------------------------------------------------------


def halves(text):
    if "!" in text:
        raise ValueError("no")
    return [(0, len(text) // 2, text[: len(text) // 2]), (len(text) // 2, len(text), text[len(text) // 2 :])]


def test_table_function(spark, texts):
    docs = texts("abcd", "", None, "x!", "😀é")
    register_segmenter(spark, "halves", halves)
    sql = "SELECT d.doc_id, s.* FROM {d} AS d, LATERAL halves(d.text) AS s"
    got, same = spark.sql(sql, d=docs), segment_with(docs, halves)
    assert got.columns == same.columns and sorted(got.collect()) == sorted(same.collect()) and got.count() == 5
    kept = spark.sql("SELECT DISTINCT d.doc_id FROM {d} AS d LEFT JOIN LATERAL halves(d.text) AS s ON true", d=docs)
    assert kept.count() == 5


# --- dictionaries -----------------------------------------------------------------


def spans_of(df):
    rows = df.select("doc_id", F.inline("spans")).collect()
    return sorted((r.doc_id, r.start, r.end, r.value, r.entity_type) for r in rows)


@pytest.mark.parametrize("most", [100, 2, 1])
@pytest.mark.parametrize("whole", [True, False])
def test_dictionary_against_search(spark, texts, most, whole):
    """One automaton or many give what a search for every value gives."""
    draw = random.Random(7)
    words = ["ab", "a", "b c", "ab cd", "d", "é", "😀", "b", "cd ab", "京A1"]
    values = [(w, t) for w in words for t in draw.sample(["X", "Y"], draw.choice([1, 1, 2]))] + [("ab", "X"), ("", "X"), (None, "X"), ("d", None)]
    docs = ["".join(draw.choice(["ab", " ", "cd", "d", "é", "😀", "b c", "京A1", ",", "_"]) for _ in range(30)) for _ in range(40)]
    df = scan_dictionary(texts(*docs, None, ""), spark.createDataFrame(values, "value string, entity_type string"), whole_words=whole, max_values=most)
    is_word = lambda c: c == "_" or c.isalnum()
    expected = []
    for k, text in enumerate(docs):
        found = []
        for w, t in {(w, t) for w, t in values if w and t}:
            at = text.find(w)
            while at >= 0:
                end = at + len(w)
                inner = (at and is_word(text[at - 1]) and is_word(w[0])) or (end < len(text) and is_word(text[end]) and is_word(w[-1]))
                if not (whole and inner):
                    found.append((at, end, w, t))
                at = text.find(w, at + 1)
        for f in found:
            if not any(g[0] <= f[0] and f[1] <= g[1] and g[:2] != f[:2] for g in found):
                expected.append((k, *f))
    assert spans_of(df) == sorted(expected)
    assert df.filter("spans IS NULL").count() == 0


def test_dictionary_spans_are_masked(spark, texts):
    values = spark.createDataFrame([("Ann Lee", "PERSON"), ("Ann", "PERSON")], "value string, entity_type string")
    df = resolve(scan_dictionary(texts("to Ann Lee, Ann and Anna"), values))
    assert redact(df, [Policy()]).first().redacted_text == "to [REDACTED], [REDACTED] and Anna"
    assert scan_dictionary(texts("x"), values.filter("false")).first().spans == []
    assert _longest([]) == []


def test_dictionary_is_one_pass(spark, texts):
    """However many files of values there are, one Python worker a task maps them all."""
    values = spark.createDataFrame([(f"value {i}", "X") for i in range(50)], "value string, entity_type string")
    df = scan_dictionary(texts("a value 7, a value 49", "value 5"), values, max_values=9)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert spans_of(df) == [(0, 2, 9, "value 7", "X"), (0, 13, 21, "value 49", "X"), (1, 0, 7, "value 5", "X")]


# --- figures of a run -------------------------------------------------------------


def test_observed(spark, texts, tmp_path):
    lost = Policy("NUMBER", operator="custom", function=lambda v: F.when(v != "13", F.lit("n")))
    masked = redact(resolve(scan(texts("1 a 2", "13", "b", None), [NUMBER])), [lost])
    seen, figures = metrics.observed(masked, ["NUMBER", "OTHER"])
    seen.select("doc_id", "redacted_text").write.parquet(str(tmp_path / "out"))
    assert figures.get == {"rows": 4, "errors": 1, "spans": 3, "n_NUMBER": 3, "n_OTHER": 0}
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan


# --- routed streams -----------------------------------------------------------------


def test_stop_between_the_two_writes(spark, tmp_path, monkeypatch):
    source, good, bad, cp = (str(tmp_path / n) for n in ("in", "good", "bad", "cp"))
    for i in range(3):
        rows = [(10 * i + k, f"call {k}" if k % 3 else None) for k in range(6)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)

    def start():
        masked = mask_stream(document_stream(spark, source, files_per_batch=1), [Policy()])
        masked = masked.withColumn("error", F.when(F.col("doc_id") % 3 == 0, "lost"))
        return routing.start_routing(masked, good, bad, "route", checkpoint=cp)

    real = routing.posixpath.join
    monkeypatch.setattr(routing.posixpath, "join", lambda *a: 1 / 0 if a[0] == bad and a[-1].endswith("=1") else real(*a))
    with pytest.raises(Exception):  # noqa: B017
        start().awaitTermination()
    monkeypatch.setattr(routing.posixpath, "join", real)
    assert spark.read.parquet(good).count() == 8  # of two batches; the errors of the second are missing
    assert spark.read.parquet(bad).count() == 2
    start().awaitTermination()
    start().awaitTermination()
    ok, failed = spark.read.parquet(good), spark.read.parquet(bad)
    assert sorted(r.doc_id for r in ok.collect()) == [10 * i + k for i in range(3) for k in range(6) if (10 * i + k) % 3]
    assert failed.count() == 6 and "redacted_text" not in failed.columns and "error" in failed.columns
