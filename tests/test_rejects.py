"""What cannot be processed comes out with a reason, and one meaning holds at every size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspan.functions.arrays import literal_array
from veilspan.operators import joins, metrics
from veilspan.operators import responses as rs
from veilspan.operators import transcript as tr
from veilspan.operators.redact import Policy, policy_table, redact_by_table
from veilspan.operators.resolve import resolve
from veilspan.operators.rules import builtin_rules, select_rules
from veilspan.operators.scan import scan
from veilspan.operators.segment import segment, segment_with
from veilspan.plans.audio import cut_list
from veilspan.plans.text import process
from veilspan.sources import readers

TEXT = "mail a.b@example.org, card 4929717705917895, see www.example.com/x"


def masked(df, policy, rows):
    found = resolve(scan(df, builtin_rules()), "cover")
    return redact_by_table(found, policy, max_rows=rows).orderBy("doc_id").select("redacted_text", "error").collect()


def test_policy_means_the_same_small_and_large(spark, texts):
    df = texts(TEXT, "nothing", None)
    for policy in (
        [Policy("URL", new_value="[U]"), Policy(new_value="[X]")],
        [Policy("EMAIL_ADDRESS", operator="mask", chars_to_mask=3), Policy(operator="redact")],
        [Policy("BANK_CARD", operator="hash", hash_type="md5")],
    ):
        table = policy_table(spark, policy)
        assert masked(df, table, 10_000) == masked(df, table, 0)
    assert masked(df, policy_table(spark, [Policy(new_value="[X]")]), 0)[0].redacted_text == "mail [X], card [X], see [X]"


def test_bad_policies_are_refused_small_and_large(spark, texts):
    good = policy_table(spark, [Policy("URL")])
    twice = good.unionByName(good.withColumn("new_value", F.lit("other")))
    keyless = good.withColumn("operator", F.lit("encrypt"))
    wide = good.withColumn("operator", F.lit("mask")).withColumn("masking_char", F.lit("**"))
    for policy in (twice, keyless, wide):
        for rows in (10_000, 0):
            with pytest.raises(ValueError, match="policy table"):
                masked(texts(TEXT), policy, rows)


def test_addresses_are_not_urls(texts):
    found = process(texts(TEXT, "a@b.com", "x@y", "ftp://u@host.org/f", "a..b@c.org"), [])
    got = [r.redacted_text for r in found.orderBy("doc_id").collect()]
    assert got[:2] == ["mail <EMAIL_ADDRESS>, card <BANK_CARD>, see <URL>", "<EMAIL_ADDRESS>"]
    assert got[2] == "x@y" and got[3] == "<URL>"
    alone = select_rules(builtin_rules(), ["EMAIL_ADDRESS"])
    spans = scan(texts("a..b@c.org", "a.b@c.org"), alone).orderBy("doc_id").collect()
    assert [len(r.spans) for r in spans][1] == 1


def test_blank_texts(texts):
    done = process(texts("\u3000\u3000", " \n", None, "x"), []).orderBy("doc_id").collect()
    assert [r.total_segments for r in done] == [0, 0, 0, 1]


def test_segments_have_any_length(texts):
    text = "x" * 20_000
    for strategy in ("whole", "sentence", "paragraph"):
        assert [len(s.text) for s in segment(texts(text), strategy).first().segments] == [20_000]
    row = segment(texts("ab. abcdef. " + text), "sentence", min_length=5, max_length=100).first()
    assert [s.text for s in row.segments] == ["abcdef."]
    assert [(s.start, len(s.text)) for s in row.outside] == [(0, 3), (12, 20_000)]


def test_custom_segmenter_reports_failures(texts):
    def halves(text):
        middle = len(text) // (len(text) - 3)
        return [(0, middle, text[:middle]), (middle, len(text), text[middle:])]

    rows = segment_with(texts("abcd", "abc", " ", None), halves).orderBy("doc_id", "seg_no").collect()
    assert [(r.doc_id, r.segment_id, r.start, r.end, r.text) for r in rows] == [
        (0, "seg_0000", 0, 4, "abcd"), (0, "seg_0001", 4, 4, ""), (1, "seg_0000", 0, 3, "abc")]
    assert [r.error for r in rows] == [None, None, "ZeroDivisionError: integer division or modulo by zero"]


def test_literals_do_not_depend_on_a_setting(spark):
    values = ["a\\b", "it's", "\\d\"", "tab\t"]
    for setting in ("false", "true"):
        spark.conf.set("spark.sql.parser.escapedStringLiterals", setting)
        try:
            assert spark.range(1).select(literal_array(values)).first()[0] == values
        finally:
            spark.conf.unset("spark.sql.parser.escapedStringLiterals")


def test_spans_without_times(spark):
    spans = spark.createDataFrame(
        [("r", 1.0, 2.0), ("r", None, None), ("r", 3.0, None), ("s", 1.0, 9.0), ("t", 0.5, 1.0)],
        "audio_id string, start_time double, end_time double",
    )
    lengths = spark.createDataFrame([("r", 1_000_000), ("s", 44_100)], "audio_id string, n_samples long")
    got = sorted((r.audio_id, r.start_sample, r.end_sample) for r in cut_list(spans, lengths).collect())
    assert got == [("r", 22050, 44100), ("s", 22050, 44100), ("t", 11025, 22050)]
    assert [r.error for r in tr.beep_rejects(spans).collect()] == ["span without times"] * 2


def test_recordings_too_short_to_split(spark):
    lengths = spark.createDataFrame([("a", 4.0), ("b", 25.0), ("c", None)], "audio_id string, duration double")
    assert {r.audio_id for r in tr.resplit_equal(lengths, "audio_id").collect()} == {"b"}
    got = {r.audio_id: r.error for r in tr.resplit_rejects(lengths, "audio_id").collect()}
    assert got == {"a": "recording too short to split", "c": "recording of unknown length"}


def test_responses_without_text_or_place(spark, texts):
    raw = [(0, '[{"entity_type": "A", "value": "here", "start": 0, "end": 4}, {"entity_type": "B", "value": "¤9", "start": 0, "end": 2}]'),
           (9, '[{"entity_type": "A", "value": "here", "start": 0, "end": 4}]')]
    read = rs.extract(spark.createDataFrame(raw, "doc_id long, raw_response string"))
    got = rs.ground(read, texts("it is here")).orderBy("doc_id").collect()
    assert [len(r.spans) for r in got] == [1, 0] and [r.error for r in got] == [None, "no text for this response"]
    left = rs.unplaced_entities(rs.ground(read, texts("it is here")), "doc_id").collect()
    assert sorted((r.doc_id, r.value, r.error) for r in left) == [
        (0, "¤9", "not found in the text"), (9, "here", "no text for this response")]


def test_unreadable_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_id": 1, "text": "x"}\n{"doc_id": \n{"text": "no key"}\n')
    path = str(tmp_path / "a.json")
    assert [tuple(r) for r in readers.read_documents(spark, path, "json").collect()] == [(1, "x")]
    assert sorted(r.error for r in readers.read_document_errors(spark, path, "json").collect()) == [
        "record without key", "unreadable record"]
    (tmp_path / "a.csv").write_text("doc_id,text\n1,x\nseven,y\n")
    path = str(tmp_path / "a.csv")
    assert [tuple(r) for r in readers.read_documents(spark, path, "csv").collect()] == [(1, "x")]
    assert [r.error for r in readers.read_document_errors(spark, path, "csv").collect()] == ["unreadable record"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "good.json").write_text('{"segments": [{"start": 0.0, "end": 1.0, "text": "a", "words": []}]}')
    (tmp_path / "t" / "bad.json").write_text("{not json")
    assert [r.audio_id for r in readers.read_transcripts(spark, str(tmp_path / "t")).collect()] == ["good"]
    assert [r.audio_id for r in readers.read_transcript_errors(spark, str(tmp_path / "t")).collect()] == ["bad"]
    line = "SPEAKER rec 1 {} 2.0 <NA> <NA> s1 <NA> <NA>\n"
    (tmp_path / "x.rttm").write_text(line.format("0.5") + line.format("soon") + "SPEAKER rec 1\nOTHER y\n")
    path = str(tmp_path / "x.rttm")
    assert [r.end_time for r in readers.read_speaker_turns(spark, path).collect()] == [2.5]
    assert readers.read_turn_errors(spark, path).count() == 2


def test_equal_lines_have_their_own_keys(spark, tmp_path):
    (tmp_path / "a.txt").write_text("same\nsame\nother\n")
    rows = readers.read_documents(spark, str(tmp_path / "a.txt"), "text").collect()
    assert len({r.doc_id for r in rows}) == 3 and {r.file.rsplit("/", 1)[1] for r in rows} == {"a.txt"}


def test_lookup_tables_are_checked(spark):
    facts = spark.createDataFrame([("a",), ("b",)], "k string")
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError, match="2 rows for k 'a'"):
        joins.lookup_join(facts, twice, "k", ["k"])
    wide = spark.createDataFrame([("a", "x" * 5000)], "k string, v string")
    assert joins.is_small(wide) and not joins.is_small(wide, max_bytes=1000)


def test_evaluation_from_marks(spark):
    marks = [(1, "A", 0, 1, True, False), (1, "A", 0, 1, False, True), (1, "B", 2, 3, True, False), (2, "A", 0, 1, False, True)]
    df = spark.createDataFrame(marks, "doc_id long, entity_type string, start int, end int, in_pred boolean, in_gold boolean")
    got = {r.entity_type: (r.tp, r.fp, r.fn) for r in metrics.precision_recall_of(df).collect()}
    assert got == {"A": (1, 0, 1), "B": (0, 1, 0), "overall": (1, 1, 1)}


def test_spreading_is_asked_for(texts):
    df = texts("a", "b").coalesce(1)
    assert readers.spread(df, None, "doc_id") is df
    assert "REPARTITION_BY_NUM" in readers.spread(df, 5, "doc_id")._jdf.queryExecution().executedPlan().toString()
