"""Scan, filters, de-duplication, overlaps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions.arrays import RUN_LENGTH, let, literal_array, running_starts
from veilspan.functions.text import find_matches
from veilspan.operators.resolve import cover_expr, dedupe_expr, greedy_expr, resolve
from veilspan.operators.rules import Rule, builtin_rules
from veilspan.operators.scan import (
    SPAN_TYPE, boost_expr, entity_list, explode_spans, keep_expr, language_or_default,
    rule_context, scan, split_valid,
)


@pytest.mark.parametrize("size", [0, 1, 2, RUN_LENGTH, RUN_LENGTH + 1, 1000])
def test_running_starts(spark, size):
    rng = random.Random(size)
    values = [rng.randrange(9) for _ in range(size)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    (row,) = df.select(running_starts(F.col("v")).alias("s")).collect()
    assert row.s == [sum(values[:i]) for i in range(size)]


def test_literals(spark):
    words = ["it's", "back\\slash", '"', "\\b", "京"]
    assert spark.range(1).select(literal_array(words)).first()[0] == words
    assert spark.range(1).select(let(F.lit(2), lambda x: x * x)).first()[0] == 4


@pytest.mark.parametrize("pattern", [r"[ab]+", r"\d\d", r"(?:x|é)y?", r"\bq[a-z1]", "😀."])
def test_places_equal_finditer(spark, pattern):
    rng = random.Random(7)
    values = ["".join(rng.choice("abxyé12q 😀\n") for _ in range(rng.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, t string")
    rows = df.select("k", F.inline(find_matches(F.col("t"), [pattern]))).collect()
    got = sorted((r.k, r.start, r.value) for r in rows)
    assert got == sorted((k, m.start(), m.group()) for k, t in enumerate(values) for m in re.finditer(pattern, t))


def test_blank_and_null(texts):
    rows = scan(texts("", "  \n", None), builtin_rules()).collect()
    assert [r.spans for r in rows] == [[], [], []]
    assert scan(texts("x"), []).first().spans == []


def _span(entity, start, end, score=0.5, pattern="p"):
    return (entity, start, end, score, "pattern", pattern, score, "v" * max(end - start, 0))


def _table(spark, rows):
    return spark.createDataFrame(rows, f"k int, spans array<{SPAN_TYPE}>, text string")


def test_filters(spark):
    spans = [_span("A", 0, 1, 0.4), _span("A", 0, 1, 0.5), _span("B", 0, 1, 0.9)]
    df = _table(spark, [(1, spans, "x")])

    def kept(*args):
        return [(s.entity_type, s.score) for s in df.select(keep_expr(F.col("spans"), *args)).first()[0]]

    assert kept(0.5) == [("A", 0.5), ("B", 0.9)]
    assert kept(None) == [("A", 0.4), ("A", 0.5), ("B", 0.9)]
    assert kept(0.5, ["A"]) == [("A", 0.5)]
    assert kept(0.5, ["ALL"], ["A"]) == [("B", 0.9)]


def test_invalid_spans_are_set_apart(spark):
    bad = [_span("A", -1, 2), _span("A", 2, 2), _span("A", 0, 1, 1.5), _span("", 0, 1)]
    row = split_valid(_table(spark, [(1, [*bad, _span("A", 0, 1)], "x")])).first()
    assert len(row.rejected) == 4 and len(row.spans) == 1


def test_context(texts):
    rule = Rule("N", "n", r"\d{4}", 0.4, context=("code",))
    df = scan(texts("code: 1234", "1234 code", "code" + " " * 60 + "1234"), [rule])
    boosted = df.select(
        boost_expr(F.col("spans"), F.col("text"), rule_context([rule]), 20, 0.35).alias("s")
    ).collect()
    assert [round(r.s[0].score, 2) for r in boosted] == [0.75, 0.4, 0.4]


def random_spans(rng):
    out = []
    for _ in range(rng.randrange(60)):
        start = rng.randrange(60)
        out.append(_span(rng.choice("ABC"), start, start + rng.randrange(1, 12),
                         rng.choice([0.5, 0.7, 0.9]), rng.choice("pqr")))
    return out


def greedy_loop(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[1], -s[3])):
        for other in kept:
            if s[1] < other[2] and s[2] > other[1]:
                if s[3] > other[3]:
                    kept.remove(other)
                    kept.append(s)
                break
        else:
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def test_greedy_equals_loop(spark):
    rng = random.Random(1)
    cases = [random_spans(rng) for _ in range(300)]
    df = _table(spark, [(i, c, "x" * 80) for i, c in enumerate(cases)])
    got = {r.k: [tuple(s) for s in r.g] for r in df.select("k", greedy_expr(F.col("spans")).alias("g")).collect()}
    for i, case in enumerate(cases):
        assert got[i] == greedy_loop(case)
        assert all(a[2] <= b[1] for a, b in zip(got[i], got[i][1:]))


def test_cover_masks_every_character(spark):
    rng = random.Random(2)
    cases = [random_spans(rng) for _ in range(200)]
    text = "".join(chr(97 + i % 26) for i in range(80))
    df = _table(spark, [(i, c, text) for i, c in enumerate(cases)])
    rows = df.select("k", cover_expr(dedupe_expr(F.col("spans")), F.col("text")).alias("c")).collect()
    for r in rows:
        hidden = {i for s in r.c for i in range(s.start, s.end)}
        assert hidden == {i for s in cases[r.k] for i in range(s[1], s[2])}
        assert all(a.end <= b.start for a, b in zip(r.c, r.c[1:]))
        for s in r.c:
            assert s.value == text[s.start : s.end]
            inside = [x for x in cases[r.k] if s.start <= x[1] < s.end]
            best = min(inside, key=lambda x: (-x[3], -x[6], x[1] - x[2], x[1], x[0]))
            assert (s.entity_type, s.score) == (best[0], best[3])


def test_dedupe(spark):
    spans = [_span("A", 0, 4, 0.5, "q"), _span("A", 0, 4, 0.9, "z"), _span("A", 0, 4, 0.9, "b"),
             _span("B", 0, 4, 0.1), _span("A", 0, 5, 0.1)]
    (row,) = _table(spark, [(1, spans, "x")]).select(dedupe_expr(F.col("spans")).alias("d")).collect()
    assert [(s.entity_type, s.end, s.pattern) for s in row.d] == [("A", 4, "b"), ("B", 4, "p"), ("A", 5, "p")]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        resolve(_table(spark, [(1, [], "x")]), "best")


def test_small_helpers(spark):
    df = spark.createDataFrame([(None,), ("auto",), ("en",)], "l string")
    assert [r[0] for r in df.select(language_or_default(F.col("l"))).collect()] == ["zh", "zh", "en"]
    df = spark.createDataFrame([(" A, B,,C ,",)], "c string")
    assert df.select(entity_list(F.col("c"))).first()[0] == ["A", "B", "C"]


def test_many_matches_in_one_text(texts):
    """One text with far more hits than a run holds."""
    rule = Rule("N", "n", "[0-9]{3}", 0.5)
    text = "123 " * 5000
    rows = explode_spans(scan(texts(text), [rule]), "doc_id").agg(
        F.count("*"), F.min("start"), F.max("end"), F.count_if(F.col("start") % 4 == 0)
    ).first()
    assert tuple(rows) == (5000, 0, 19999, 5000)
