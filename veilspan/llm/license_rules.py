"""Licence texts by sentence rules.

A text's sentences are normalised and looked up among known licence sentences; the
identifiers found, in the order of the text, are matched against ordered rules, each a
sequence of identifiers that stands for a licence. All of it is built-in expressions on
the text's own row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences by identifier (fixed values, from the public licence texts).
SENTENCES = {
    "mit-name": "The MIT License",
    "mit-title": "MIT License",
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-distributed": "Distributed under the MIT License.",
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-names": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "bsd-short": "Licensed under the BSD License.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-released": "Released under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-terms": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed '
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "gpl2-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "gpl2-only": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; version 2 of the License."
    ),
    "lgpl2-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "lgpl21-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version."
    ),
    "lgpl21-only": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; version 2.1 of the License."
    ),
    "lgpl3-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "agpl3-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "apache-text": "Apache License.\nVersion 2.0, January 2004.",
    "gpl2-text": "GNU GENERAL PUBLIC LICENSE.\nVersion 2, June 1991.",
    "gpl3-text": "GNU GENERAL PUBLIC LICENSE.\nVersion 3, 29 June 2007.",
    "lgpl21-text": "GNU LESSER GENERAL PUBLIC LICENSE.\nVersion 2.1, February 1999.",
    "lgpl3-text": "GNU LESSER GENERAL PUBLIC LICENSE.\nVersion 3, 29 June 2007.",
    "agpl3-text": "GNU AFFERO GENERAL PUBLIC LICENSE.\nVersion 3, 19 November 2007.",
    "mpl2-text": "Mozilla Public License Version 2.0.",
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc0": "Licensed under CC0 1.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# Licence and its sequence of sentences; earlier rules come first and use up what they match (fixed values).
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy", "apache-terms")),
    ("Apache-2.0", ("apache-grant", "apache-use")),
    ("Apache-2.0", ("apache-grant",)),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-released",)),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-2.0-only", ("gpl2-only", "gpl-warranty")),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-2.0-only", ("gpl2-short",)),
    ("LGPL-2.0-or-later", ("lgpl2-later",)),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("LGPL-2.1-only", ("lgpl21-only",)),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("Apache-2.0", ("apache-text",)),
    ("GPL-2.0-only", ("gpl2-text",)),
    ("GPL-3.0-only", ("gpl3-text",)),
    ("LGPL-2.1-only", ("lgpl21-text",)),
    ("LGPL-3.0-only", ("lgpl3-text",)),
    ("AGPL-3.0-only", ("agpl3-text",)),
    ("MPL-2.0", ("mpl2-text",)),
    ("MPL-2.0", ("mpl2",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-distributed",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-title",)),
    ("BSD", ("bsd-short",)),
]

#: One of these words is in every known sentence; texts without any are not taken apart.
TRIGGER = r"licens|permi|redistribut|warrant|unencumbered"
CUT = "\x01"
#: A sentence ends at its mark and white space, or at a blank line; a line may be a sentence, too.
SENTENCE_END = r"""[.!?;:]["')\]]*(?:[ \t\r\n]+|$)|\n[ \t\r]*\n"""
LINE_END = r"""[.!?;:]["')\]]*(?:[ \t\r\n]+|$)|\n"""
BETWEEN_WORDS = r"[^a-z0-9\x01]+"
#: A clause that names an organisation, and as the known sentence has it; a name may have a mark as in "Inc.".
NAMED = r"neither the names? of [a-z0-9 \x01]{1,200}?[ \x01]nor the names? of (?:its|their|any|the) contributors may"
UNNAMED = "neither the name of the copyright holder nor the names of its contributors may"


def _plain_sentence(sentence: str) -> str:
    """A known sentence as the expressions below leave it."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def _check() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """Identifiers of known parts, and the identifiers that each sentence is made of.

    A sentence with end marks inside has an identifier for each part from the first that holds
    a trigger; what comes before, as in "This program is free software", may have other words.
    """
    import re

    known: dict[str, str] = {}
    made_of: dict[str, tuple[str, ...]] = {}
    for name, sentence in SENTENCES.items():
        parts = [_plain_sentence(p) for p in re.split(SENTENCE_END, sentence) if p and _plain_sentence(p)]
        start = next((i for i, p in enumerate(parts) if re.search(TRIGGER, p)), len(parts))
        parts = parts[start:]
        names = [name] if len(parts) == 1 else [f"{name}-{i}" for i in range(1, len(parts) + 1)]
        sequence = tuple(known.setdefault(p, n) for p, n in zip(parts, names, strict=True))
        if not sequence or sequence in made_of.values():
            raise ValueError(f"licence sentence {name} cannot be told from others")
        made_of[name] = sequence
    return known, made_of


KNOWN, MADE_OF = _check()
RULES = [(licence, tuple(i for name in names for i in MADE_OF[name])) for licence, names in RULES]


def _identifiers(text: Column, ends: str) -> Column:
    """Known identifiers in the order of the text, each between bars: ``|a||b|``."""
    cut = F.regexp_replace(F.lower(text), ends, CUT)
    plain = F.regexp_replace(F.regexp_replace(cut, BETWEEN_WORDS, " "), NAMED, UNNAMED)
    parts = F.split(plain, CUT)
    known = F.map_from_arrays(
        F.array(*[F.lit(k) for k in KNOWN]), F.array(*[F.lit(f"|{name}|") for name in KNOWN.values()])
    )
    return F.array_join(F.transform(parts, lambda s: F.coalesce(F.element_at(known, F.trim(s)), F.lit(""))), "")


def _matched(identifiers: Column) -> Column:
    """Licences whose rules match, each rule using up what it matches."""
    found = []
    for licence, sequence in RULES:
        wanted = F.lit("".join(f"|{name}|" for name in sequence))
        found.append(F.when(F.contains(identifiers, wanted), F.lit(licence)))
        identifiers = F.replace(identifiers, wanted, F.lit("#"))
    return F.array_compact(F.array(*found))


def licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``licenses`` and ``sentence_ids`` of every row.

    ``licenses`` are the distinct licences found, in alphabetical order, joined by commas, and
    ``sentence_ids`` the identifiers of the known sentences in the order of the text, joined by
    commas; both are empty for texts without any, null and empty ones included. Sentences may
    be broken over lines, and a line may stand for a sentence. Repeated keys give a row each,
    an empty table gives an empty one, other columns are not read. No shuffle, no Python.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    ids = [F.when(F.lower(body).rlike(TRIGGER), _identifiers(body, e)).otherwise(F.lit("")) for e in (SENTENCE_END, LINE_END)]
    rows = docs.select(F.col(key).alias("key"), ids[0].alias("by_sentence"), ids[1].alias("by_line"))
    every = F.array_union(_matched(F.col("by_sentence")), _matched(F.col("by_line")))
    longer = F.when(F.length("by_line") > F.length("by_sentence"), F.col("by_line")).otherwise(F.col("by_sentence"))
    return rows.select(
        F.col("key").alias(key),
        F.array_join(F.array_sort(every), ",").alias("licenses"),
        F.replace(F.trim(longer, F.lit("|")), F.lit("||"), F.lit(",")).alias("sentence_ids"),
    )


def licences_sql(table: str, key: str = "doc_id", text: str = "text") -> str:
    """The same in plain SQL of another engine, for checks."""

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def identifiers(ends: str) -> str:
        cut = f"regexp_replace(lower(coalesce({text}, '')), {quoted(ends)}, chr(1), 'g')"
        plain = f"regexp_replace({cut}, {quoted(BETWEEN_WORDS)}, ' ', 'g')"
        parts = f"string_split(regexp_replace({plain}, {quoted(NAMED)}, {quoted(UNNAMED)}, 'g'), chr(1))"
        return (
            f"CASE WHEN regexp_matches(lower(coalesce({text}, '')), {quoted(TRIGGER)}) THEN "
            f"array_to_string(list_transform({parts}, lambda s: coalesce(known.m[trim(s, ' ')], '')), '') ELSE '' END"
        )

    def matched(column: str) -> str:
        def step(state: tuple[str, list[str]], rule: tuple) -> tuple[str, list[str]]:
            rest, found = state
            wanted = quoted("".join(f"|{name}|" for name in rule[1]))
            found = [*found, f"CASE WHEN contains({rest}, {wanted}) THEN {quoted(rule[0])} END"]
            return f"replace({rest}, {wanted}, '#')", found

        return "[" + ", ".join(reduce(step, RULES, (column, []))[1]) + "]"

    names = ", ".join(quoted(k) for k in KNOWN)
    marks = ", ".join(quoted(f"|{v}|") for v in KNOWN.values())
    return f"""
WITH known AS (SELECT map([{names}], [{marks}]) AS m),
ids AS (
  SELECT {key}, {identifiers(SENTENCE_END)} AS a, {identifiers(LINE_END)} AS b FROM {table}, known
), hits AS (
  SELECT {key}, list_concat({matched("a")}, {matched("b")}) AS l,
    CASE WHEN length(b) > length(a) THEN b ELSE a END AS longer
  FROM ids
)
SELECT {key}, array_to_string(list_sort(list_distinct(list_filter(l, lambda x: x IS NOT NULL))), ',') AS licenses,
  replace(trim(longer, '|'), '||', ',') AS sentence_ids
FROM hits
"""
