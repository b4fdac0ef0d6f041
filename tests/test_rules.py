"""Patterns and checks on literals."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions import checks
from veilspan.operators.reference_values import RULE_TABLE
from veilspan.operators.rules import (
    Rule, builtin_rules, credit_card_rules, rule_table, select_rules, supported_entities,
)
from veilspan.operators.scan import explode_spans, scan

AS_OF = dt.date(2025, 1, 1)

CHINESE = (
    "我的姓名是张三，来自北京。\n我的车牌号是京A12345，手机号码是13812345678。\n"
    "我的身份证号是210102199203183096，银行卡号是4929717705917895。\n\n"
    "2023年10月15日，我访问了www.example.com并发送邮件到test@example.com，IP地址是192.168.1.1。"
)
ENGLISH = (
    "My credit card number is 4095-2609-9393-4932 .\nOn 11/10/2024 I visited www.example.org and "
    "sent an email to test@example.site,  from IP 192.168.0.1.\nphone (212) 555-1234, "
    "account IL150120690000003111111 , number 078-05-1126, licence 1234567A."
)
SAMPLES = {
    "bank_card_standard": "a 1234567890123456789 b 12345678901234567",
    "bank_card_with_separator": "x 4095-2609-9393-4932-123 y 4095 2609 9393 4932",
    "bank_card_standard_visa": "4111111111111111 and 411",
    "bank_card_standard_mastercard": "5105105105105100",
    "bank_card_standard_unionpay": "6212261234567890",
    "bank_card_with_bin": "3530111333300000 30569309025904000 621226123456789012",
    "car_plate_pattern": "京A12345 和 沪BZZZZZ",
    "new_energy_car_plate": "粤BD12345",
    "special_car_plate": "WJ12345 QABCDE",
    "embassy_car_plate": "使123456 使A1234",
    "hk_macao_car_plate": "粤Z1234港 粤ZABCD1",
    "id_card_18": "11010119900101123X 210102199203183096",
    "id_card_15": "110101900101123",
    "id_card_with_separator": "110101 1990-01-01 123 X",
    "id_card_15_with_separator": "110101-900101-123",
    "mobile_standard": "tel 13812345678, 138123456789",
    "mobile_with_separator": "138-1234-5678 and 139 1234 5678.",
    "mobile_with_country_code": "+86 13812345678 0086-138 1234 5678",
    "mobile_in_parentheses": "(+86)13812345678 (86) 138-1234-5678",
    "mobile_special_format": "1381-2345-6789",
    "url_with_protocol": "see https://a.example.com/x?y=1#z or ftp://f.example.net",
    "url_with_www": "at www.example.com/path.",
    "simple_domain": "mail a.b@example.co.uk or example.com/x",
    "ip_address_url": "http://192.168.1.1:8080/x 10.0.0.1",
    "cjk_domain": "见 例子.公司 或 例え.com",
    "email": "write to first.last+tag@sub.example.org now",
}


@pytest.mark.parametrize("rule", builtin_rules(validate=False), ids=lambda r: r.name)
def test_pattern_places(texts, rule):
    """Same places and values as a plain regex search, with triggers and leads in force."""
    values = [SAMPLES[rule.name], CHINESE, ENGLISH, "", "nothing here", SAMPLES[rule.name] * 3]
    got = {
        (r.doc_id, r.start, r.value)
        for r in explode_spans(scan(texts(*values), [rule]), "doc_id").collect()
    }
    want = set()
    for key, text in enumerate(values):
        for m in re.finditer(rule.regex, text):
            value = re.sub(r"[\s\-.]+\Z", "", m.group()) if rule.trim else m.group()
            want.add((key, m.start(), value))
    assert any(key == 0 for key, _, _ in want), "the sample shows no hit"
    assert got == want


def test_catalogue_is_complete(spark):
    assert len(RULE_TABLE) == 26
    assert rule_table(spark, builtin_rules()).count() == 26
    names = [r.entity_type for r in supported_entities(spark, builtin_rules()).collect()]
    assert names == ["BANK_CARD", "CAR_PLATE", "EMAIL_ADDRESS", "ID_CARD", "PHONE_NUMBER", "URL"]


def verdicts(spark, check, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    return [r.ok for r in rows.select(check(F.col("v")).alias("ok")).collect()]


@pytest.mark.parametrize(
    "check, good, bad",
    [
        (
            checks.is_bank_card,
            ["4929717705917895", "4095-2609-9393-4932", "4095 2609.9393　4932"],
            ["6222020111122223333", "6225881234567890", "6212261234567890123", "411111111111111",
             "492971770591789x", ""],
        ),
        (
            lambda v: checks.is_id_card(v, AS_OF),
            ["210102199203183096", "11010119900101123７".replace("７", "7")[:17] + "7",
             "110101900101123", "110101 19900101 1237"],
            ["110101199001011234", "990101199001011237", "110101199013011237", "110101189901011237",
             "11010119900230123X", "110101203001011237", "12345", "11010199023012X"],
        ),
        (
            checks.is_mobile_number,
            ["13812345678", "138-1234-5678", "+86 13812345678", "0086-13812345678",
             "(+86)13812345678", "13808612345"],
            ["12812345678", "1381234567", "138123456789", "86 13812345678"],
        ),
        (
            checks.is_car_plate,
            ["京A12345", "京A·12345", "粤BD12345", "粤B12345F", "WJ12345", "粤Z1234A"],
            ["京A1234", "京AABCDE", "京712345", "粤BD1234X", "QABCDE", "使123456", "WJ123456"],
        ),
        (
            checks.is_url,
            ["www.example.com", "https://a.b.museum/x", "X.CN", "example.com?x", "<example.org>"],
            ["nodots", "192.168.1.1", "a.b1", "v1.2.3"],
        ),
    ],
    ids=["bank_card", "id_card", "phone", "plate", "url"],
)
def test_checks(spark, check, good, bad):
    assert verdicts(spark, check, good) == [True] * len(good)
    assert verdicts(spark, check, bad) == [False] * len(bad)


def test_check_codes(spark):
    """Against the sum written out, for 200 numbers."""
    weights, codes = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2], "10X98765432"
    values = [f"1101011990{i % 12 + 1:02d}{i % 28 + 1:02d}{i:03d}" for i in range(200)]
    want = [codes[sum(int(c) * w for c, w in zip(v, weights)) % 11] for v in values]
    assert verdicts(spark, checks.id_check_code, values) == want


def test_card_names(spark):
    rows = spark.createDataFrame(
        [("6228480402564890018",), ("4111111111111111",), ("5105",), ("378282246310005",),
         ("3530",), ("6011000990139424",), ("65",), ("99",)], "v string")
    got = rows.select(checks.bank_name(F.col("v")), checks.card_scheme(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [
        ("农业银行", "UnionPay"), (None, "Visa"), (None, "MasterCard"), (None, "American Express"),
        (None, "JCB"), (None, "Discover"), (None, "Discover"), (None, None),
    ]


def test_selection():
    rules = builtin_rules()
    assert {r.entity_type for r in select_rules(rules, ["URL", "ID_CARD"], ["URL"])} == {"ID_CARD"}
    assert len(select_rules(rules, ["ALL"])) == 26
    assert len(select_rules(rules, disabled=["simple_domain", "BANK_CARD"])) == 19
    assert select_rules(rules, languages=["en"]) == []
    assert {r.entity_type for r in credit_card_rules()} == {"CREDIT_CARD"}


def test_bad_rules_are_refused():
    with pytest.raises(ValueError):
        Rule("X", "x", "a*", 0.5)
    with pytest.raises(ValueError):
        Rule("X", "x", "a", 1.5)
    with pytest.raises(ValueError):
        Rule("", "x", "a", 0.5)


def test_ascii_digits_only(texts):
    """Full-width digits are no digits."""
    found = explode_spans(scan(texts("１2"), [Rule("N", "n", r"\d+", 0.5)]), "doc_id").collect()
    assert [(r.start, r.value) for r in found] == [(1, "2")]


def test_boundary_next_to_chinese(texts):
    rules = select_rules(builtin_rules(validate=False), ["PHONE_NUMBER"])
    found = explode_spans(scan(texts("手机号13812345678"), rules), "doc_id").collect()
    assert {r.pattern for r in found} == {"mobile_with_separator"}
