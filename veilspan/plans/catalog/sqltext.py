"""SQL for the oracle side: matching, checking and settling spans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from ...operators.rules import Rule


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A rule's pattern as RE2 takes it."""
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)


def hits(name: str, source: str, rules: Sequence[Rule], key: str = "doc_id") -> str:
    """CTE ``name``: raw matches of ``rules`` in ``source``, trimmed, unchecked."""
    keys = [k.strip() for k in key.split(",")]
    listed = ", ".join(keys)
    raws = " UNION ALL ".join(
        f"SELECT {listed}, text, {quoted(r.entity_type)} AS entity_type, {quoted(r.name)} AS pattern, "
        f"CAST({float(r.score)} AS DOUBLE) AS pattern_score, {'TRUE' if r.trim else 'FALSE'} AS trims, "
        f"regexp_extract_all(text, {quoted(re2(r.regex))}) AS vals, "
        f"string_split_regex(text, {quoted(re2(r.regex))}) AS gaps FROM {source}"
        for r in rules
    )
    return f"""
{name}_raw AS ({raws}),
{name}_each AS (
  SELECT {listed}, text, entity_type, pattern, pattern_score, trims, vals, gaps,
    UNNEST(range(1, len(vals) + 1)) AS i
  FROM {name}_raw WHERE len(vals) > 0
),
{name}_at AS (
  SELECT {listed}, text, entity_type, pattern, pattern_score,
    CASE WHEN trims THEN regexp_replace(vals[i], '[\\s\\-.]+$', '') ELSE vals[i] END AS value,
    CAST(list_sum([length(g) for g in gaps[1:i]])
      + coalesce(list_sum([length(v) for v in vals[1:i-1]]), 0) AS INTEGER) AS "start"
  FROM {name}_each
),
{name} AS (
  SELECT {listed}, text, entity_type, pattern, pattern_score, pattern_score AS score, value, "start",
    CAST("start" + length(value) AS INTEGER) AS "end"
  FROM {name}_at
)"""


def removed(value: str, literals: Sequence[str]) -> str:
    for literal in literals:
        value = f"replace({value}, {quoted(literal)}, '')"
    return value


def luhn(digits: str) -> str:
    """Luhn test of a digit string."""
    return (
        f"(list_sum([CASE WHEN (length({digits}) - k) % 2 = 0 THEN CAST(substring({digits}, k, 1) AS INTEGER) "
        f"ELSE (CAST(substring({digits}, k, 1) AS INTEGER) * 2) % 10 "
        f"+ (CAST(substring({digits}, k, 1) AS INTEGER) * 2) // 10 END "
        f"for k in range(1, length({digits}) + 1)]) % 10 = 0)"
    )


def valid_card(value: str) -> str:
    from ...operators.reference_values import REMOVALS

    v = removed(value, REMOVALS["BANK_CARD"])
    return (
        f"(CASE WHEN regexp_full_match({v}, '[0-9]{{16,19}}') THEN {luhn(v)} ELSE FALSE END)"
    )


def valid_phone(value: str) -> str:
    from ...operators.reference_values import REMOVALS

    v = f"regexp_replace({removed(value, REMOVALS['PHONE_NUMBER'])}, '^(\\+86|0086|086|\\+)', '')"
    return (
        f"(regexp_full_match({v}, '1[3-9][0-9]{{9}}') AND NOT regexp_matches({value}, '[0-9]{{12,}}'))"
    )


def valid_plate(value: str) -> str:
    from ...operators.reference_values import PLATE_PROVINCES, REMOVALS

    v = removed(value, REMOVALS["CAR_PLATE"])
    head = f"[{PLATE_PROVINCES}][A-Z]"
    return (
        f"((regexp_full_match({v}, '{head}([A-Z0-9]{{5}}|[A-Z0-9]{{5}}[DF0-9])') "
        f"AND regexp_matches(substring({v}, 3), '[0-9]')) "
        f"OR regexp_full_match({v}, '[WJQGB][A-Z0-9]{{6}}'))"
    )


def valid_url(value: str) -> str:
    from ...operators.reference_values import REMOVALS, TOP_LEVEL_DOMAINS

    v = removed(value, REMOVALS["URL"])
    tlds = "|".join(TOP_LEVEL_DOMAINS)
    return (
        f"(regexp_matches({v}, '(?i)\\.({tlds})($|/|\\?|#)') OR regexp_matches({v}, "
        f"'(?i)([a-z0-9][-a-z0-9]{{0,62}}\\.)+[a-z]{{2,}}($|/|\\?|#)'))"
    )


def valid_id(value: str, as_of: str) -> str:
    from ...operators.reference_values import (
        ID_AREA_PREFIXES, ID_CHECK_CODES, ID_WEIGHTS, REMOVALS,
    )

    v = f"upper({removed(value, REMOVALS['ID_CARD'])})"
    areas = ", ".join(quoted(a) for a in ID_AREA_PREFIXES)
    weighed = " + ".join(
        f"TRY_CAST(substring({v}, {i}, 1) AS INTEGER) * {w}"
        for i, w in enumerate(ID_WEIGHTS, start=1)
    )

    def born(digits: str) -> str:
        return (
            f"coalesce(CAST(try_strptime({digits}, '%Y%m%d') AS DATE) "
            f"BETWEEN DATE '1900-01-01' AND DATE '{as_of}', FALSE)"
        )

    area = f"substring({v}, 1, 2) IN ({areas})"
    return (
        f"(CASE WHEN regexp_full_match({v}, '[0-9]{{17}}[0-9X]') THEN {area} "
        f"AND {born(f'substring({v}, 7, 8)')} "
        f"AND substring('{ID_CHECK_CODES}', CAST(({weighed}) % 11 + 1 AS INTEGER), 1) = substring({v}, 18, 1) "
        f"WHEN regexp_full_match({v}, '[0-9]{{15}}') THEN {area} "
        f"AND {born(f'''('19' || substring({v}, 7, 6))''')} ELSE FALSE END)"
    )


def checked(name: str, source: str, as_of: str = "1999-01-01") -> str:
    """CTE ``name``: hits that pass their type's check, scored 1.0; unchecked types as they are."""
    return f"""
{name} AS (
  SELECT * REPLACE (
    CASE WHEN entity_type IN ('BANK_CARD', 'CAR_PLATE', 'ID_CARD', 'PHONE_NUMBER', 'URL', 'EMAIL_ADDRESS')
      THEN CAST(1.0 AS DOUBLE) ELSE score END AS score)
  FROM {source}
  WHERE CASE entity_type
    WHEN 'BANK_CARD' THEN {valid_card('value')}
    WHEN 'CAR_PLATE' THEN {valid_plate('value')}
    WHEN 'ID_CARD' THEN {valid_id('value', as_of)}
    WHEN 'PHONE_NUMBER' THEN {valid_phone('value')}
    WHEN 'URL' THEN {valid_url('value')} AND (pattern <> 'simple_domain' OR strpos(value, '@') = 0)
    WHEN 'EMAIL_ADDRESS' THEN regexp_full_match(value,
      '[A-Za-z0-9_%+-]+(\\.[A-Za-z0-9_%+-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\\.)+[A-Za-z]{{2,}}')
    ELSE TRUE END
)"""


def deduped(name: str, source: str, key: str = "doc_id") -> str:
    """CTE ``name``: best score, then first pattern name, per (key, type, start, end)."""
    return f"""
{name} AS (
  SELECT * FROM {source} QUALIFY row_number() OVER (
    PARTITION BY {key}, entity_type, "start", "end" ORDER BY score DESC, pattern) = 1
)"""


def covered(name: str, source: str, key: str = "doc_id") -> str:
    """CTE ``name``: runs of overlapping spans merged, labelled by their best member."""
    return f"""
{name}_reach AS (
  SELECT *, max("end") OVER (PARTITION BY {key} ORDER BY "start", "end", entity_type, pattern
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}
),
{name}_numbered AS (
  SELECT *, sum(CASE WHEN "start" < reach THEN 0 ELSE 1 END) OVER (PARTITION BY {key}
    ORDER BY "start", "end", entity_type, pattern ROWS UNBOUNDED PRECEDING) AS island
  FROM {name}_reach
),
{name} AS (
  SELECT * REPLACE (lo AS "start", hi AS "end", substring(text, lo + 1, hi - lo) AS value) FROM (
    SELECT *, min("start") OVER w AS lo, max("end") OVER w AS hi,
      row_number() OVER (PARTITION BY {key}, island ORDER BY score DESC, pattern_score DESC,
        "end" - "start" DESC, "start", entity_type, pattern) AS place
    FROM {name}_numbered WINDOW w AS (PARTITION BY {key}, island)
  ) WHERE place = 1
)"""


def masked(name: str, spans: str, source: str, replacement: str, key: str = "doc_id") -> str:
    """CTE ``name``: ``source`` texts with ``spans`` replaced, and the number of spans."""
    return f"""
{name}_edits AS (
  SELECT {key}, text, "start", "end", {replacement} AS repl,
    coalesce(lag("end") OVER (PARTITION BY {key} ORDER BY "start"), 0) AS prev
  FROM {spans}
),
{name}_joined AS (
  SELECT {key}, count(*) AS n,
    string_agg(substring(text, prev + 1, "start" - prev) || repl, '' ORDER BY "start")
      || substring(any_value(text), max("end") + 1) AS out
  FROM {name}_edits GROUP BY {key}
),
{name} AS (
  SELECT s.{key}, s.text, coalesce(j.n, 0) AS n_entities, coalesce(j.out, s.text) AS redacted_text
  FROM {source} s LEFT JOIN {name}_joined j ON s.{key} = j.{key}
)"""


def items(name: str, spans: str, replacement: str, operator: str, key: str = "doc_id") -> str:
    """CTE ``name``: log of edits with offsets in the masked text."""
    return f"""
{name}_edits AS (
  SELECT {key}, entity_type, "start" AS s0, "end" AS e0, {replacement} AS repl, {operator} AS operator
  FROM {spans}
),
{name}_moved AS (
  SELECT *, coalesce(sum(length(repl) - (e0 - s0)) OVER (PARTITION BY {key} ORDER BY s0
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift
  FROM {name}_edits
),
{name} AS (
  SELECT {key}, CAST(s0 + shift AS INTEGER) AS "start",
    CAST(s0 + shift + length(repl) AS INTEGER) AS "end", entity_type, repl AS text, operator
  FROM {name}_moved
)"""


def with_query(ctes: Sequence[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes) + "\n" + select
