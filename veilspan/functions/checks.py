"""Checks of a matched value: ``Column -> boolean Column``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.reference_values import (
    BANK_BY_BIN,
    CARD_SCHEME_PREFIXES,
    ID_AREA_PREFIXES,
    ID_CHECK_CODES,
    ID_WEIGHTS,
    PLATE_PROVINCES,
    REMOVALS,
    TOP_LEVEL_DOMAINS,
)
from .arrays import let


def remove_literals(value: Column, literals: tuple[str, ...]) -> Column:
    """Remove fixed strings, one after the other in the order given."""
    for literal in literals:
        value = F.replace(value, F.lit(literal), F.lit(""))
    return value


def card_digits(value: Column) -> Column:
    return remove_literals(value, REMOVALS["BANK_CARD"])


def is_bank_card(value: Column) -> Column:
    return let(
        card_digits(value),
        lambda v: F.when(v.rlike(r"^[0-9]{16,19}\z"), F.call_function("luhn_check", v)).otherwise(
            F.lit(False)
        ),
    )


def bank_name(value: Column) -> Column:
    """Issuing bank of a card number by its first six digits, or null."""
    names = F.create_map(*[F.lit(x) for pair in BANK_BY_BIN.items() for x in pair])
    return let(card_digits(value), lambda v: F.try_element_at(names, F.substring(v, 1, 6)))


def card_scheme(value: Column) -> Column:
    """Card network by leading digits, or null."""

    def chain(v: Column) -> Column:
        out = F.lit(None).cast("string")
        for scheme, prefixes in reversed(CARD_SCHEME_PREFIXES):
            out = F.when(v.rlike("^(?:" + "|".join(prefixes) + ")"), F.lit(scheme)).otherwise(out)
        return out

    return let(card_digits(value), chain)


def id_check_code(first17: Column) -> Column:
    """Check character of an 18-character identity number (ISO 7064, mod 11-2)."""
    total = F.lit(0)
    for place, weight in enumerate(ID_WEIGHTS, start=1):
        total = total + F.substring(first17, place, 1).cast("int") * weight
    return F.substring(F.lit(ID_CHECK_CODES), total % 11 + 1, F.lit(1))


def is_id_card(value: Column, as_of: dt.date | None = None) -> Column:
    """Identity number: area, birth date and, with 18 characters, check character.

    ``as_of`` is the last birth date allowed; fix it for repeatable results.
    """
    latest = F.current_date() if as_of is None else F.lit(as_of)

    def born_well(digits: Column) -> Column:
        born = F.try_to_date(digits, "yyyyMMdd")
        return let(
            born,
            lambda d: F.coalesce((d >= F.lit(dt.date(1900, 1, 1))) & (d <= latest), F.lit(False)),
        )

    def verdict(v: Column) -> Column:
        area_known = F.substring(v, 1, 2).isin(list(ID_AREA_PREFIXES))
        return (
            F.when(
                v.rlike(r"^[0-9]{17}[0-9X]\z"),
                area_known
                & born_well(F.substring(v, 7, 8))
                & (id_check_code(v) == F.substring(v, 18, 1)),
            )
            .when(
                v.rlike(r"^[0-9]{15}\z"),
                area_known & born_well(F.concat(F.lit("19"), F.substring(v, 7, 6))),
            )
            .otherwise(F.lit(False))
        )

    return let(F.upper(remove_literals(value, REMOVALS["ID_CARD"])), verdict)


def phone_digits(value: Column) -> Column:
    """Separators out, country code off the front only (inner ``086`` is part of the number)."""
    return F.regexp_replace(
        remove_literals(value, REMOVALS["PHONE_NUMBER"]), r"^(?:\+86|0086|086|\+)", ""
    )


def is_mobile_number(value: Column) -> Column:
    return phone_digits(value).rlike(r"^1[3-9][0-9]{9}\z") & ~value.rlike(r"[0-9]{12,}")


def is_car_plate(value: Column) -> Column:
    province = f"^[{PLATE_PROVINCES}][A-Z]"
    return let(
        remove_literals(value, REMOVALS["CAR_PLATE"]),
        lambda v: (
            v.rlike(province + r"(?=.*[0-9])[A-Z0-9]{5}\z")
            | v.rlike(province + r"(?=.*[0-9])[A-Z0-9]{5}[DF0-9]\z")
            | v.rlike(r"^[WJQGB][A-Z0-9]{6}\z")
        ),
    )


def is_email(value: Column) -> Column:
    """One ``@`` between a local part and a dotted name that ends in letters, no empty part."""
    return value.rlike(
        r"^[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}\z"
    )


def is_bare_domain(value: Column) -> Column:
    """A URL without scheme or ``www``; with an ``@`` it is an address, not a place on the web."""
    return is_url(value) & ~F.contains(value, F.lit("@"))


def is_url(value: Column) -> Column:
    known = r"(?i)\.(?:" + "|".join(TOP_LEVEL_DOMAINS) + r")(?:$|/|\?|#)"
    general = r"(?i)(?:[a-z0-9][-a-z0-9]{0,62}\.)+[a-z]{2,}(?:$|/|\?|#)"
    return let(
        remove_literals(value, REMOVALS["URL"]), lambda v: v.rlike(known) | v.rlike(general)
    )
