"""Response formats, every way to place an entity, prompts and cache."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from veilspan.operators import prompts as pr
from veilspan.operators import responses as rs

TEXT = "张三 called 13812345678, mail a@b.com and J.R. Smith's card. Call 13812345678 end"


@pytest.fixture(scope="module")
def read(spark):
    def run(*raws):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "doc_id long, raw_response string")
        return rs.extract(df)

    return run


JSON = """以下是识别结果：
```json
[{"entity_type": "person", "value": "张三", "start": 0, "end": "2", "confidence": 0.95,
  "is_inferred": false, "notes": "n", "metadata": {"a": "b"}},
 {"entity_type": "X", "value": "y"}, {"entity_type": "X", "value": "y", "start": 3, "end": 3}]
```
根据分析，找到了1个实体。
"""
RELAXED = "[\n  {\n entity_type: 'PERSON',\n value: '张三',\n start: 0,\n end: 2,\n confidence: 0.95,\n },\n]"
LINES = "识别到以下实体：\nPERSON: 张三 (位置: 0-2)\nEMAIL: a@b.com (position: 10-27)\nx: y (3-1)\nPhone: 138 (35-46)"
TABLE = (
    "识别结果如下：\n| 实体类型 | 实体值 | 起始位置 | 结束位置 | 置信度 |\n|---|---|---|---|---|\n"
    "| person | 张三 | 0 | 2 | 0.95 |\n| EMAIL | a@ | 10 | 25 | 0.9 |\n| X | | 1 | 2 | 0.5 |"
)


def test_formats(read):
    rows = read(JSON, RELAXED, LINES, TABLE, "nothing", "[broken", "[]", None).orderBy("doc_id").collect()
    assert [r.parse_method for r in rows] == ["json", "relaxed_json", "lines", "table"] + [None] * 4
    first = rows[0].entities[0]
    assert (first.entity_type, first.value, first.start, first.end, first.confidence) == ("PERSON", "张三", 0, 2, 0.95)
    assert (first.is_inferred, first.notes) == (False, "n") and '"a"' in first.metadata
    assert len(rows[0].rejected) == 2
    assert [e.confidence for e in rows[1].entities] == [0.95]
    assert [(e.entity_type, e.start, e.confidence) for e in rows[2].entities] == [
        ("PERSON", 0, 0.8), ("EMAIL", 10, 0.8), ("PHONE", 35, 0.8)]
    assert [e.value for e in rows[3].entities] == ["张三", "a@"]
    assert rows[1].errors == ["json: not readable"]
    assert rows[5].errors == ["json: not readable", "relaxed_json: not readable"]
    assert rows[6].errors == []


def test_cleaning(spark):
    df = spark.createDataFrame([(JSON,), ("```json\n{}\n```",), (" a \n 根据 x\n b如下\n c ",)], "r string")
    got = [r.c for r in df.select(rs.clean_response(F.col("r")).alias("c")).collect()]
    assert got[0].startswith("[{") and got[1:] == ["{}", "a\nc"]


@pytest.mark.parametrize(
    "entity, want",
    [
        (("张三", 0, 2, 0.9), (0, 2, "张三", 0.9, "none")),
        (("张三", 0, 2, 0.4), None),
        (("13812345678", 8, 22, 0.9), (10, 21, "13812345678", 0.81, "narrowed")),
        (("13812345678", 12, 18, 0.9), (12, 18, "812345", 0.72, "shortened")),
        (("a@b.com", 3, 5, 0.9), (28, 35, "a@b.com", 0.9, "moved")),
        (("13812345678", 0, 2, 0.4), (10, 21, "13812345678", 0.4, "moved")),
        (("Smi-th", 46, 50, 0.9), (45, 50, "Smith", 0.63, "near")),
        (("Smi-th", 0, 1, 0.9), None),
        (("a@b.com", 500, 507, 0.9), (28, 35, "a@b.com", 0.81, "search")),
        (("MAIL", 500, 504, 0.9), (23, 27, "mail", 0.72, "case_search")),
        (("j r  smith", 500, 510, 0.9), (40, 50, "J.R. Smith", 0.63, "loose_search")),
        (("??", 500, 502, 0.9), None),
        (("nobody", 500, 506, 0.9), None),
        (("  ", 500, 502, 0.9), None),
        (("end", 75, 900, 0.9), None),
    ],
)
def test_placing(spark, entity, want):
    value, start, end, confidence = entity
    df = spark.createDataFrame(
        [([("X", value, start, end, confidence, None, None, None)], TEXT)],
        f"e array<{rs.FOUND_TYPE}>, t string",
    )
    spans = df.select(rs.ground_expr(F.col("e"), F.col("t")).alias("s")).first().s
    if entity[0] == "end":  # end of the text: clamped, then narrowed or exact
        assert [(s.value, s.end) for s in spans] == [("end", len(TEXT))]
        return
    got = [(s.start, s.end, s.value, round(s.score, 6), s.repair) for s in spans]
    assert got == ([] if want is None else [want])
    for s in spans:
        assert (s.is_inferred is True) == s.repair.endswith("search")


@pytest.mark.parametrize(("text", "value", "place"), [
    ("İİ call Bob Smith here", "BOB SMITH", (8, 17)), ("İ a İb", "İB", (4, 6)), ("Straße İ ÄB x", "äb", (9, 11)),
    ("İİ J.R. Smith", "j r  smith", (3, 13)),
])
def test_letters_that_grow_in_lower_case(spark, text, value, place):
    """Places are those of the text, whatever its letters become."""
    df = spark.createDataFrame([([("X", value, 500, 510, 0.9, None, None, None)], text)], f"e array<{rs.FOUND_TYPE}>, t string")
    (span,) = df.select(rs.ground_expr(F.col("e"), F.col("t")).alias("s")).first().s
    assert (span.start, span.end) == place and span.value == text[slice(*place)]


def test_overlaps_and_order(spark):
    entities = [("A", "mail a@b.com", 23, 35, 0.7, None, None, None), ("B", "a@b.com", 28, 35, 0.9, None, None, None),
                ("C", "张三", 0, 2, 0.8, None, None, None)]
    df = spark.createDataFrame([(entities, TEXT)], f"e array<{rs.FOUND_TYPE}>, t string")
    spans = df.select(rs.ground_expr(F.col("e"), F.col("t")).alias("s")).first().s
    assert [s.entity_type for s in spans] == ["C", "B"]


def test_ground_joins_texts(spark, read, texts):
    spans = rs.ground(read(JSON, "no"), texts(TEXT, "other", "no response")).orderBy("doc_id").collect()
    assert [len(r.spans) for r in spans] == [1, 0]


def test_prompts(spark):
    template = "A {{ text }} of {{ entities }} {{text}} {{ who }}"
    df = spark.createDataFrame([("hello {{ entities }}",)], "t string")
    row = df.select(
        pr.render_prompt(template, text=F.col("t"), entities=["X", "Y"]).alias("p"),
        pr.template_variables(F.lit(template)).alias("v"),
        pr.missing_variables(F.lit(template), ["text"]).alias("m"),
    ).first()
    assert row.p == "A hello X, Y of X, Y {{text}} {{ who }}"
    assert row.v == ["entities", "text", "who"] and row.m == ["entities", "who"]


def test_cache(spark):
    now = dt.datetime(2024, 1, 1, 12)
    prompts = spark.createDataFrame([("p",), ("p",), ("q",), ("r",)], "prompt string").withColumn(
        "key", pr.cache_key(F.col("prompt"), "m", 0.5))
    assert prompts.first().key == hashlib.md5(b'{"model":"m","prompt":"p","temperature":0.5}').hexdigest()
    keys = {r.prompt: r.key for r in prompts.collect()}
    cache = spark.createDataFrame(
        [(keys["p"], "old", now - dt.timedelta(minutes=50)), (keys["p"], "new", now - dt.timedelta(minutes=5)),
         (keys["q"], "late", now - dt.timedelta(minutes=61))], "key string, response string, created_at timestamp")
    live = pr.live_cache(cache, now)
    assert [(r.key, r.response) for r in live.collect()] == [(keys["p"], "new")]
    assert {r.prompt for r in pr.calls_to_make(prompts, live).collect()} == {"q", "r"}
    answers = spark.createDataFrame([("q", None, 5), ("r", "timed out", 0)], "key string, error string, tokens long")
    row = pr.request_counters(prompts, live, answers).first()
    assert row.asDict() == {"total_requests": 4, "cache_hits": 2, "calls": 2, "errors": 1, "retries": 0, "total_tokens": 5}


def test_loose_places_against_all_windows(spark):
    """The first window that equals the value but for case and punctuation, on random strings."""
    import random
    import re

    draw = random.Random(4)
    rows = []
    for _ in range(300):
        text = "".join(draw.choice("ab A.-,") for _ in range(draw.randrange(0, 40)))
        value = "".join(draw.choice("abAB.- ") for _ in range(draw.randrange(1, 7)))
        rows.append((text, value))
    df = spark.createDataFrame(rows, "t string, v string")
    bare = rs._no_punctuation(F.lower("v"))
    got = df.select("t", "v", rs._loose_place(F.split("t", "", -1), F.length("t"), bare, F.length("v")).alias("at")).collect()

    def plain(x):
        return re.sub(r"\W", "", x.lower())

    for r in got:
        n = len(r.v)
        first = next((i for i in range(len(r.t) - n + 1) if plain(r.t[i : i + n]) == plain(r.v)), None)
        if len(plain(r.v)) >= 3:  # shorter ones are not searched for
            assert r["at"] is None or plain(r.t[r["at"] : r["at"] + n]) == plain(r.v)
            # of occurrences that overlap each other, the first counts
            assert r["at"] == first or plain(r.v) * 2 in plain(r.t) or len(set(plain(r.v))) < 3, (r, first)
