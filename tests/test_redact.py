"""Masking."""

import hashlib
import re
import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions.masks import decrypt_value
from veilspan.operators.redact import (
    Policy, audit_log, config_policy, explode_items, operator_list, policy_from_rows, policy_table,
    rebuild_expr, redact, redact_by_table, restore,
)
from veilspan.operators.resolve import resolve
from veilspan.operators.rules import Rule
from veilspan.operators.scan import scan

NUMBER = Rule("NUMBER", "number", "[0-9]+", 0.5)
WORD = Rule("WORD", "word", "[a-z]+", 0.5)


def masked(df, policy, rules=(NUMBER, WORD)):
    return redact(resolve(scan(df, list(rules))), policy)


def one(df, policy, rules=(NUMBER, WORD)):
    return masked(df, policy, rules).first().redacted_text


@pytest.mark.parametrize(
    "policy, want",
    [
        ([], "京 <NUMBER>, <WORD>!"),
        ([Policy()], "京 [REDACTED], [REDACTED]!"),
        ([Policy("NUMBER", new_value="#")], "京 #, <WORD>!"),
        ([Policy("NUMBER", operator="redact"), Policy(new_value="-")], "京 , -!"),
        ([Policy("NUMBER", operator="mask"), Policy(operator="redact")], "京 *****, !"),
        ([Policy("NUMBER", operator="mask", chars_to_mask=2), Policy(operator="redact")], "京 123**, !"),
        ([Policy("NUMBER", operator="mask", chars_to_mask=2, from_end=False, masking_char="x"),
          Policy(operator="redact")], "京 xx345, !"),
        ([Policy("NUMBER", operator="mask", chars_to_mask=99), Policy(operator="redact")], "京 *****, !"),
        ([Policy("NUMBER", operator="hash"), Policy(operator="redact")],
         f"京 {hashlib.sha256(b'12345').hexdigest()}, !"),
        ([Policy("NUMBER", operator="hash", hash_type="sha512"), Policy(operator="redact")],
         f"京 {hashlib.sha512(b'12345').hexdigest()}, !"),
        ([Policy("NUMBER", operator="hash", hash_type="md5", salt="s"), Policy(operator="redact")],
         f"京 {hashlib.md5(b's12345').hexdigest()}, !"),
        ([Policy("NUMBER", operator="custom", function=lambda v: F.reverse(v)), Policy(operator="redact")],
         "京 54321, !"),
    ],
)
def test_operators(texts, policy, want):
    assert one(texts("京 12345, abc!"), policy) == want


def test_encryption_comes_back(texts):
    key = b"k" * 32
    edits = masked(texts("call 555 now"), [Policy("NUMBER", operator="encrypt", key=key)], [NUMBER])
    row = edits.select("redacted_text", F.col("edits")[0].getField("replacement").alias("r")).first()
    assert "555" not in row.redacted_text
    back = edits.select(decrypt_value(F.col("edits")[0].getField("replacement"), key).alias("v"),
                        decrypt_value(F.lit("AAAA"), key).alias("w")).first()
    assert (back.v, back.w) == ("555", None)


@pytest.mark.parametrize(
    "wrong",
    [dict(operator="encrypt"), dict(operator="nope"), dict(operator="custom"),
     dict(operator="hash", hash_type="crc"), dict(operator="mask", masking_char="**")],
)
def test_bad_policies(wrong):
    with pytest.raises(ValueError):
        Policy(**wrong)


def test_bad_key(texts):
    with pytest.raises(ValueError):
        masked(texts("1"), [Policy(operator="encrypt", key="short")])


def test_fails_closed(texts):
    """A value without a replacement takes its text with it."""
    lost = Policy("NUMBER", operator="custom", function=lambda v: F.lit(None).cast("string"))
    rows = masked(texts("a 1 b 2", "a b"), [lost], [NUMBER]).orderBy("doc_id").collect()
    assert rows[0].redacted_text is None and rows[0].error
    assert rows[1].redacted_text == "a b" and rows[1].error is None


def test_same_value_gives_same_text(texts):
    rng = random.Random(3)
    values = ["".join(rng.choice("ab1 2京😀\n") for _ in range(rng.randrange(200))) for _ in range(50)]
    kept = Policy(operator="custom", function=lambda v: v)
    rows = masked(texts(*values), [kept]).select("text", "redacted_text").collect()
    assert all(r.text == r.redacted_text for r in rows)


def test_items_point_into_the_output(texts):
    df = masked(texts("aa 11 bb 22 cc", "x"), [Policy("NUMBER", new_value="[N]")], [NUMBER])
    rows = explode_items(df, "doc_id", "redacted_text").collect()
    assert len(rows) == 2
    assert all(r.redacted_text[r.start : r.end] == r.text == "[N]" for r in rows)
    assert audit_log(df, "doc_id").columns == ["doc_id", "start", "end", "entity_type", "operator"]


def test_no_edits(texts):
    none = F.array().cast("array<struct<start:int,end:int,replacement:string>>")
    rows = texts("x", None, "").select(rebuild_expr(F.col("text"), none).alias("t")).collect()
    assert [r.t for r in rows] == ["x", None, ""]


def test_policy_table_small_and_large_give_the_same(spark, texts):
    df = resolve(scan(texts("12345 abc 京", "no", None, "", "7 q 8"), [NUMBER, WORD]))
    table = policy_table(spark, [Policy("NUMBER", operator="mask", chars_to_mask=2),
                                 Policy("OTHER", new_value="x")])
    small = redact_by_table(df, table).select("doc_id", "redacted_text", "items", "error")
    large = redact_by_table(df, table, max_rows=0).select("doc_id", "redacted_text", "items", "error")
    assert sorted(small.collect()) == sorted(large.collect())
    hashed = policy_table(spark, [Policy("NUMBER", operator="hash", hash_type="md5")])
    row = redact_by_table(df, hashed, max_rows=0).filter("doc_id = 0").first()
    assert row.redacted_text == hashlib.md5(b"12345").hexdigest() + " <WORD> 京"


@pytest.mark.parametrize("max_rows", [10, 0])
@pytest.mark.parametrize("fillers", [0, 100])
def test_policy_table_and_keys(spark, max_rows, fillers):
    """Null and repeated keys, and texts without spans, at every size of the policy."""
    rows = [(None, "mail 12345 now"), (1, "card 77 x"), (1, "write 8 and 9"), (None, None), (2, "none here")]
    df = resolve(scan(spark.createDataFrame(rows, "doc_id long, text string"), [NUMBER]))
    policy = [Policy(new_value="[X]"), *[Policy(f"T{i}", new_value="y") for i in range(fillers)]]
    masked_ = redact_by_table(df, policy_table(spark, policy), max_rows=max_rows and max_rows + fillers)
    got = sorted(masked_.select("doc_id", "text", "redacted_text", "error").collect(), key=repr)
    assert got == sorted([(k, t, t and re.sub("[0-9]+", "[X]", t), None) for k, t in rows], key=repr)


def test_policy_table_of_many_types(spark, texts):
    policy = [Policy(f"T{i}", new_value=str(i)) for i in range(200)] + [Policy("NUMBER", operator="mask", chars_to_mask=1)]
    df = resolve(scan(texts("12345 abc"), [NUMBER, WORD]))
    for limit in (1000, 5):
        row = redact_by_table(df, policy_table(spark, policy), max_rows=limit).first()
        assert row.redacted_text == "1234* <WORD>"
    with pytest.raises(ValueError):
        redact_by_table(df, policy_table(spark, policy), max_types=20)
    with pytest.raises(ValueError):
        redact_by_table(df, policy_table(spark, policy).selectExpr("nullif(entity_type, 'T3') AS entity_type", "operator"))


def test_restore(texts):
    key = "k" * 16
    df = masked(texts("a 1 b 22", "none", None, "3", "😀 4京"), [Policy(operator="encrypt", key=key)], [NUMBER])
    back = restore(df, key).orderBy("doc_id").select("text", "restored_text", "restore_error").collect()
    assert all(r.text == r.restored_text for r in back)
    assert [r.restore_error for r in back] == [None, None, "no masked text", None, None]
    wrong = restore(df, "w" * 16).orderBy("doc_id").collect()
    assert [r.restored_text for r in wrong] == [None, "none", None, None, None]
    assert wrong[0].restore_error == "a value cannot be decrypted"
    cut = restore(df.withColumn("redacted_text", F.expr("substring(redacted_text, 1, 20)")), key).filter("doc_id = 0").first()
    assert cut.restored_text is None and cut.restore_error == "items do not fit the text"
    changed = restore(df.withColumn("redacted_text", F.expr("replace(redacted_text, 'A', 'B')")), key)
    assert changed.filter("doc_id = 0").first().restored_text in (None, "a 1 b 22")
    twice = restore(df.withColumn("items", F.concat("items", "items")), key).filter("doc_id = 0").first()
    assert twice.restored_text is None and twice.restore_error == "items do not fit the text"
    lost = masked(texts("a 1", "b"), [Policy()], [NUMBER])
    assert [r.restore_error for r in restore(lost, key).orderBy("doc_id").collect()] == ["a value was not encrypted", None]
    assert restore(df.withColumn("items", F.lit(None).cast(df.schema["items"].dataType)), key).filter("doc_id = 1").first().restored_text == "none"


def test_policy_rows(spark):
    back = policy_from_rows(policy_table(spark, config_policy()).collect())
    assert [p.entity_type for p in back] == [p.entity_type for p in config_policy()]
    assert set(operator_list()) == {"replace", "mask", "hash", "redact", "encrypt", "custom"}
