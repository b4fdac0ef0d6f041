"""Text helpers. Offsets are 0-based, end-exclusive and count code points."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, literal_array, running_starts


# White space of every script, as stripped off the ends of texts.
EDGE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]``."""
    return F.substring(text, start + 1, end - start)


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(strip(text)) == 0)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(EDGE_SPACE))


def portable_regex(pattern: str) -> str:
    """Fix what would otherwise depend on the Java release.

    ``\\b`` looks at Unicode letters up to Java 18 and at ASCII only later; the
    explicit flag keeps the Unicode meaning everywhere.
    """
    return re.sub(r"(?<!\\)((?:\\\\)*)\\b", r"\1(?U:\\b)", pattern)


def check_not_empty(pattern: str) -> None:
    """Refuse rules that can match nothing: they have no place in the text."""
    try:
        empty = re.search(pattern, "") is not None
    except re.error:  # Java-only syntax: matches are checked again when scanned
        return
    if empty:
        raise ValueError(f"pattern can match the empty string: {pattern!r}")


def find_matches(
    text: Column, patterns: Sequence[str], guards: Sequence[Column | None] | None = None
) -> Column:
    """Every non-overlapping match of every pattern, with the pattern's number.

    Values come from ``regexp_extract_all``; the gaps between them, from ``split``,
    are measured only for patterns with a hit, so that text without any is
    scanned once per pattern. A match starts after all earlier gaps and values.
    ``guards`` switch patterns off for texts that cannot match.
    """
    regexes = [portable_regex(p) for p in patterns]
    guards = list(guards) if guards is not None else [None] * len(regexes)
    regex_of = literal_array(regexes)
    whole = F.lit(0)

    def values_of(number: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(regexes[number]), whole)
        return found if guards[number] is None else F.when(guards[number], found)

    def place(hit: Column) -> Column:
        rule, values = hit.getField("rule"), hit.getField("values")
        gaps = F.transform(F.split(text, regex_of[rule], -1), F.length)
        return let(
            gaps,
            lambda g: let(
                running_starts(
                    F.zip_with(
                        F.slice(g, F.lit(1), F.size(values)), values, lambda n, v: n + F.length(v)
                    )
                ),
                lambda before: F.transform(
                    values,
                    lambda v, i: F.struct(
                        rule.alias("rule"), (before[i] + g[i]).alias("start"), v.alias("value")
                    ),
                ),
            ),
        )

    numbered = F.transform(
        F.array(*[values_of(n) for n in range(len(regexes))]),
        lambda values, n: F.struct(n.alias("rule"), values.alias("values")),
    )
    hits = F.filter(numbered, lambda h: F.size(h.getField("values")) > 0)
    return F.flatten(F.transform(hits, place))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of ``words`` occurs in ``text``."""
    return text.rlike("|".join(re.escape(w) for w in words))
