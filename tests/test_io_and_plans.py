"""Readers, writers, whole plans, streams, and the shape of physical plans."""

import json

import pytest
from pyspark.sql import functions as F

from veilspan.operators.joins import is_small, lookup_join
from veilspan.operators.metrics import confidence_report, error_rate, precision_recall
from veilspan.operators.redact import Policy, config_policy
from veilspan.operators.rules import Rule, builtin_rules
from veilspan.plans import audio
from veilspan.plans.catalog import queries
from veilspan.plans.text import analyze, process, result_record
from veilspan.sources import readers, writers
from veilspan.streaming.masking import document_stream, mask_stream, start_masking

NUMBER = Rule("NUMBER", "number", "[0-9]{4,}", 0.5)


def physical(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    return df._jdf.queryExecution().executedPlan().toString()


# --- readers and writers ------------------------------------------------------------


def test_documents_in_every_format(spark, tmp_path, texts):
    df = texts("a, b", "c")
    for fmt in ("parquet", "json", "orc"):
        df.write.format(fmt).save(str(tmp_path / fmt))
    df.write.option("header", True).csv(str(tmp_path / "csv"))
    for fmt in ("parquet", "json", "orc", "csv"):
        back = readers.read_documents(spark, str(tmp_path / fmt), fmt)
        assert sorted(map(tuple, back.collect())) == [(0, "a, b"), (1, "c")]
    (tmp_path / "t.txt").write_text("x\ny\n", encoding="utf-8")
    lines = readers.read_documents(spark, str(tmp_path / "t.txt"), "text")
    assert sorted(r.text for r in lines.collect()) == ["x", "y"]
    with pytest.raises(ValueError):
        readers.read_documents(spark, str(tmp_path), "xml")


def test_turns(spark, tmp_path):
    (tmp_path / "a.rttm").write_text(
        "SPEAKER rec1 1 0.50 2.25 <NA> <NA> spk_0 <NA> <NA>\n"
        "SPKR-INFO rec1 1 <NA> <NA> <NA> unknown spk_0 <NA> <NA>\n"
        "SPEAKER rec1 1 oops 1 <NA> <NA> spk_1 <NA> <NA>\n", encoding="utf-8")
    rows = readers.read_speaker_turns(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("rec1", "spk_0", 0.5, 2.75)]


TRANSCRIPT = {
    "segments": [
        {"start": 0.0, "end": 4.0, "text": "call 1381 2345 now", "words": [
            {"word": "call", "start": 0.0, "end": 0.5, "score": 0.9},
            {"word": "1381", "start": 1.0, "end": 2.0, "score": 0.9},
            {"word": "2345", "start": 2.0, "end": 3.0, "score": 0.9},
            {"word": "now"}]},
        {"start": 5.0, "end": 8.0, "text": "code 98765"},
    ]
}


@pytest.fixture(scope="module")
def transcripts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("t")
    (path / "rec1.json").write_text(json.dumps(TRANSCRIPT, indent=1), encoding="utf-8")
    return readers.read_transcripts(spark, str(path))


def test_recording_from_end_to_end(spark, transcripts):
    turns = spark.createDataFrame([("rec1", "s1", 0.0, 4.5), ("rec1", "s2", 4.6, 9.0)],
                                  "audio_id string, speaker_id string, start_time double, end_time double")
    spans = audio.detect(transcripts, turns, rules=[NUMBER])
    got = sorted((r.value, r.start, r.start_time, r.end_time, r.speaker_id) for r in spans.collect())
    # One word has no time, so the first segment's own times hold for all of it.
    assert got == [("1381", 5, 0.0, 4.0, "s1"), ("2345", 10, 0.0, 4.0, "s1"), ("98765", 24, 5.0, 8.0, "s2")]
    lengths = spark.createDataFrame([("rec1", 22_050 * 6)], "audio_id string, n_samples long")
    cuts = sorted((r.start_sample, r.end_sample, r.n) for r in audio.cut_list(spans, lengths).collect())
    assert cuts == [(0, 88_200, 2), (110_250, 132_300, 1)]
    text = audio.masked_transcripts(transcripts, [Policy()], rules=[NUMBER]).first()
    assert text.redacted_text == "call [REDACTED] [REDACTED] now code [REDACTED]"
    assert audio.detect(transcripts, rules=[NUMBER]).filter("speaker_id IS NULL").count() == 3


def test_responses_and_boxes(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"doc_id": 1, "raw_response": "x"}\n', encoding="utf-8")
    assert tuple(readers.read_responses(spark, str(tmp_path / "r.json")).first()) == (1, "x")
    (tmp_path / "o.json").write_text(
        '{"image_id": 1, "words": [{"word_no": 0, "text": "a", "left": 1, "top": 2, "width": 3, "height": 4, "conf": 0.5}]}\n',
        encoding="utf-8")
    assert readers.read_ocr_words(spark, str(tmp_path / "o.json")).first().words[0].left == 1
    assert readers.area_table(spark).count() == 35 and readers.bin_table(spark).count() == 14


def test_sinks(spark, tmp_path, texts):
    bad = Policy("NUMBER", operator="custom", function=lambda v: F.when(v != "1234", v))
    done = process(texts("a 1234", "b 5678", ""), [bad], rules=[NUMBER])
    writers.write_by_status(done, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    rows = {r.doc_id: (r.status, r.text, r.redacted_text, r.error) for r in back.collect()}
    assert rows[0][:3] == ("error", None, None) and rows[0][3]
    assert rows[1][:3] == ("ok", "b 5678", "b 5678") and rows[2][0] == "ok"
    record = writers.as_json(result_record(done)).filter("doc_id = 1").first().result
    assert json.loads(record)["metadata"] == {"total_segments": 1, "total_entities": 1}
    writers.write_result(done.select("doc_id"), str(tmp_path / "plain"), "json")
    assert spark.read.json(str(tmp_path / "plain")).count() == 3


# --- whole plans --------------------------------------------------------------------


def test_process(texts):
    df = texts("tel 13812345678 or 4929717705917895, a@b.org", " ", None)
    rows = process(df, config_policy()).orderBy("doc_id").collect()
    assert rows[0].redacted_text == "tel 1381******* or ************7895, [EMAIL]"
    assert (rows[0].total_segments, rows[0].total_entities) == (1, 3)
    assert [(r.redacted_text, r.total_segments, r.total_entities) for r in rows[1:]] == [(" ", 0, 0), (None, 0, 0)]
    some = process(df, entities=["BANK_CARD"], segment_by="sentence").filter("doc_id = 0").first()
    assert (some.redacted_text, some.total_segments) == ("tel 13812345678 or <BANK_CARD>, a@b.org", 2)
    with pytest.raises(ValueError):
        process(df, overlap="none")


def test_analyze_options(texts):
    df = texts("code 1234 and 5678", "1234")
    low = Rule("NUMBER", "number", "[0-9]{4,}", 0.4, context=("code",))
    assert [len(r.spans) for r in analyze(df, [low]).orderBy("doc_id").collect()] == [0, 0]
    assert [len(r.spans) for r in analyze(df, [low], context_window=6).orderBy("doc_id").collect()] == [1, 0]
    assert [len(r.spans) for r in analyze(df, [low], threshold=None).orderBy("doc_id").collect()] == [2, 1]


def test_quality(spark):
    pred = spark.createDataFrame([(1, "A", 0, 1), (1, "A", 2, 3), (1, "B", 0, 1)], "doc_id int, entity_type string, start int, end int")
    gold = spark.createDataFrame([(1, "A", 0, 1), (1, "C", 0, 1), (1, "C", 0, 1)], "doc_id int, entity_type string, start int, end int")
    rows = {r.entity_type: (r.tp, r.fp, r.fn, round(r.f1, 3)) for r in precision_recall(pred, gold).collect()}
    assert rows == {"A": (1, 1, 0, 0.667), "B": (0, 1, 0, 0.0), "C": (0, 0, 1, 0.0), "overall": (1, 2, 1, 0.4)}
    empty = spark.createDataFrame([], "score double")
    assert tuple(confidence_report(empty).first()) == (0, 0.0)
    stages = spark.createDataFrame([("a", None), ("a", "x")], "stage string, error string")
    assert error_rate(stages, "stage").first().error_rate == 0.5


def test_lookup_join_with_a_hot_key(spark):
    facts = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("5", 2), ("7777", 3)], "k string, v int")
    small = lookup_join(facts, table, "k", ["id"])
    large = lookup_join(facts, table, "k", ["id"], max_rows=2)
    assert "BroadcastHashJoin" in physical(small)
    assert sorted(small.select("id", "v").collect(), key=str) == sorted(large.select("id", "v").collect(), key=str)
    assert not is_small(table, 2) and is_small(table, 3)


# --- streams ------------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path, texts):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = texts("tel 13812345678", "card 4929717705917895", "", "京A12345")
    df.repartition(2).write.parquet(source)
    stream = mask_stream(document_stream(spark, source, files_per_batch=1), config_policy())
    start_masking(stream, out, "mask", checkpoint=str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(str, spark.read.parquet(out).select("doc_id", "redacted_text").collect()))
    want = process(df, config_policy()).select("doc_id", "redacted_text").collect()
    assert got == sorted(map(str, want))


def test_stream_needs_a_shared_folder(spark, tmp_path):
    df = mask_stream(document_stream(spark, str(tmp_path)))
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            start_masking(df, str(tmp_path / "o"), "n")


# --- physical plans -----------------------------------------------------------------


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """As many files as cores; nothing is dealt out."""
    path = str(tmp_path_factory.mktemp("wide") / "d")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(8).write.parquet(path)
    return readers.spread(readers.read_documents(spark, path), None, "doc_id")


def test_masking_is_one_narrow_pass(wide):
    plan = physical(process(wide, config_policy()).select("doc_id", "redacted_text", "items"))
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert plan.count("regexp_extract_all(text") == len(builtin_rules())


def test_exploding_spans_does_not_scan_twice(wide):
    from veilspan.operators.scan import explode_spans

    plan = physical(explode_spans(analyze(wide), "doc_id"))
    assert "Exchange" not in plan
    assert plan.count("regexp_extract_all(text") == len(builtin_rules())


def test_unwanted_rules_are_not_scanned(wide):
    plan = physical(analyze(wide, entities=["BANK_CARD"]))
    assert plan.count("regexp_extract_all(text") == 6


def test_counts_shuffle_partial_sums_only(spark, sf_dir):
    plan = physical(queries()["entities_by_source"](spark, sf_dir))
    assert "partial_count" in plan


def test_range_joins_are_keyed(spark, sf_dir):
    for name in ("span_to_time", "span_to_speaker", "ocr_boxes_join", "beep_islands"):
        plan = physical(queries()[name](spark, sf_dir))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
