"""Rules: what to look for, how sure a hit is, and how to check it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import checks
from ..functions.text import check_not_empty
from .reference_values import CONTEXT_WORDS, RULE_TABLE

DEFAULT_LANGUAGE = "zh"
DEFAULT_THRESHOLD = 0.5


@dataclass(frozen=True)
class Rule:
    """One pattern.

    ``validator`` turns a matched value into a boolean Column; a hit that fails
    is dropped, a hit that passes gets score 1.0. ``trigger`` is a fixed string
    and ``trigger_regex`` a cheap pattern that any text with a hit must contain:
    texts without it skip the rule. ``lead`` is a cheap pattern that every match
    starts with: places without it skip the rule. ``trim`` lists characters cut off the
    end of a match.
    """

    entity_type: str
    name: str
    regex: str
    score: float
    validator: Callable[[Column], Column] | None = None
    language: str = DEFAULT_LANGUAGE
    context: tuple[str, ...] = field(default=())
    trigger: str | None = None
    trigger_regex: str | None = None
    trim: str | None = None
    lead: str | None = None
    recognizer: str = "pattern"

    @property
    def search_regex(self) -> str:
        return f"(?={self.lead}){self.regex}" if self.lead else self.regex

    def __post_init__(self) -> None:
        check_not_empty(self.regex)
        if not self.entity_type or not self.name:
            raise ValueError("a rule needs an entity type and a name")
        if not 0.0 <= self.score <= 1.0:
            raise ValueError(f"score of rule {self.name} is outside 0..1")


_TRIGGERS = {
    "mobile_with_country_code": "86",
    "mobile_in_parentheses": "86)",
    "embassy_car_plate": "使",
    "hk_macao_car_plate": "粤Z",
    "url_with_protocol": "://",
    "url_with_www": "www.",
    "simple_domain": ".",
    "ip_address_url": ".",
    "cjk_domain": ".",
    "email": "@",
}
_TRIGGER_REGEXES = {
    "mobile_standard": "[0-9]{4}",
    "mobile_special_format": "[0-9]{4}",
    "cjk_domain": r"[぀-ヿ㐀-䶿一-鿿]\.",
    "ip_address_url": r"[0-9]\.[0-9]",
    "car_plate_pattern": "[一-鿿][A-Z]",
    "new_energy_car_plate": "[一-鿿][A-Z]",
}
# A range is one comparison, a long list of characters is one per character.
_LEADS = {"car_plate_pattern": "[一-鿿][A-Z]", "new_energy_car_plate": "[一-鿿][A-Z]"}
_TRIGGER_REGEX_BY_TYPE = {"BANK_CARD": "[0-9]{4}", "ID_CARD": "[0-9]{4}"}
# A number ends at its last digit, whatever separators the pattern ran over.
_TRIM_BY_TYPE = {
    "BANK_CARD": " \t\n\v\f\r-.",
    "PHONE_NUMBER": " \t\n\v\f\r-.",
}


def builtin_rules(as_of: dt.date | None = None, validate: bool = True) -> list[Rule]:
    """The shipped rules, in catalogue order.

    ``as_of`` is the latest birth date an identity number may carry (default:
    today). With ``validate=False`` every hit keeps its pattern score.
    """
    validators: dict[str, Callable[[Column], Column]] = {
        "BANK_CARD": checks.is_bank_card,
        "CAR_PLATE": checks.is_car_plate,
        "ID_CARD": lambda v: checks.is_id_card(v, as_of),
        "PHONE_NUMBER": checks.is_mobile_number,
        "URL": checks.is_url,
        "EMAIL_ADDRESS": checks.is_email,
    }
    by_name = {"simple_domain": checks.is_bare_domain}
    return [
        Rule(
            entity_type=entity_type,
            name=name,
            regex=regex,
            score=score,
            validator=by_name.get(name, validators.get(entity_type)) if validate else None,
            context=tuple(CONTEXT_WORDS[entity_type]),
            trigger=_TRIGGERS.get(name),
            trigger_regex=_TRIGGER_REGEXES.get(name, _TRIGGER_REGEX_BY_TYPE.get(entity_type)),
            trim=_TRIM_BY_TYPE.get(entity_type),
            lead=_LEADS.get(name),
        )
        for entity_type, name, regex, score in RULE_TABLE
    ]


def ip_address_rule() -> Rule:
    """Bare or schemed IPv4 addresses as a type of their own, unchecked."""
    (base,) = [r for r in builtin_rules(validate=False) if r.name == "ip_address_url"]
    return replace(base, entity_type="IP_ADDRESS", name="ip_address", context=())


def credit_card_rules() -> list[Rule]:
    """The card rules under the type name CREDIT_CARD."""
    return [
        replace(r, entity_type="CREDIT_CARD", name=r.name.replace("bank_card", "credit_card"))
        for r in builtin_rules()
        if r.entity_type == "BANK_CARD"
    ]


def select_rules(
    rules: Iterable[Rule],
    entities: Iterable[str] | None = None,
    denied: Iterable[str] = (),
    languages: Iterable[str] | None = None,
    disabled: Iterable[str] = (),
) -> list[Rule]:
    """Leave out rules whose hits would be dropped anyway, before any text is read.

    ``disabled`` switches off entity types or single rule names. ``entities``
    may hold ``ALL``.
    """
    wanted = None if entities is None else set(entities)
    if wanted is not None and "ALL" in wanted:
        wanted = None
    unwanted, off = set(denied), set(disabled)
    spoken = None if languages is None else set(languages)
    return [
        r
        for r in rules
        if (wanted is None or r.entity_type in wanted)
        and r.entity_type not in unwanted
        and r.entity_type not in off
        and r.name not in off
        and (spoken is None or r.language in spoken)
    ]


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """The rules as a table."""
    return spark.createDataFrame(
        [(r.entity_type, r.name, r.regex, float(r.score), r.language) for r in rules],
        "entity_type string, pattern string, regex string, pattern_score double, language string",
    )


def supported_entities(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return rule_table(spark, rules).select("entity_type").distinct().orderBy("entity_type")
