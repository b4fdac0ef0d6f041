"""Quality rules by repetition coverage: how much of a text lies in repeated word runs and lines.

Per text, words become numbers, rolling hashes of them stand for the word runs of
several lengths, and the characters of all words inside runs that occur again are
counted, each word once. Lines equal to an earlier line are counted likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import keep_rows, map_texts

#: Largest share of characters (per cent) inside repeated runs of so many words.
GRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT = 20
MIN_WORDS = 50
REPEAT_LIMIT = 50
BASE_WINDOW = 3
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, "
    + ", ".join(f"dup{n}_chars long" for n in GRAM_LIMITS)
)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)


def _covered(keys: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Which words lie in a window whose key occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(n_words + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:-1]) > 0


def _chars(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def measure(raw: bytes | None) -> tuple:
    """The columns of ``SCHEMA`` for one text; a null text is an empty one."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    lengths = np.fromiter((_chars(w) if not w.isascii() else len(w) for w in seen), dtype=np.int64, count=len(seen))
    lengths = lengths[ids] if n else np.zeros(0, dtype=np.int64)
    word_chars = int(lengths.sum())
    n_symbols = sum(raw.count(bytes([s])) for s in SYMBOLS)

    lines: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in raw.split(b"\n"):
        if not line.strip():
            continue
        if line in lines:
            n_dup_lines += 1
            dup_line_chars += sum(map(_chars, line.split()))
        else:
            lines.add(line)

    repeat_words = 0
    if n >= BASE_WINDOW:
        # exact: windows are numbered pair by pair, without hashing
        keys = ids[:-1] * len(seen) + ids[1:]
        keys = np.unique(keys, return_inverse=True)[1][:-1].astype(np.int64) * len(seen) + ids[2:]
        repeat_words = int(_covered(keys, BASE_WINDOW, n).sum())

    inside = dict.fromkeys(GRAM_LIMITS, 0)
    values = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
    values ^= values >> _SHIFT
    rolling = values
    for width in range(2, max(GRAM_LIMITS) + 1):
        if n < width or not repeat_words:
            break  # no longer run can repeat either
        rolling = rolling[:-1] * _BASE + values[width - 1 :]
        if width in GRAM_LIMITS:
            chars = int(lengths[_covered(rolling, width, n)].sum())
            inside[width] = chars
            if not chars:
                break
    base_failed = n < MIN_WORDS or 100 * repeat_words > REPEAT_LIMIT * n
    kept = (
        not base_failed
        and 100 * dup_line_chars <= LINE_LIMIT * word_chars
        and all(100 * inside[w] <= limit * word_chars for w, limit in GRAM_LIMITS.items())
    )
    return (n, word_chars, n_symbols, n_dup_lines, repeat_words, base_failed, kept, dup_line_chars, *inside.values())


def repetition_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key`` and the columns of ``SCHEMA``.

    Null and empty texts have no words and fail. Repeated keys give a row each, ties
    do not arise, an empty table gives an empty one, and other columns are not read.
    No shuffle: each text is judged where it is read.
    """

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in batches:
            yield [keys, *map(list, zip(*map(measure, texts), strict=True))] if keys else [[]] * (len(GRAM_LIMITS) + 9)

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs, [key, text], work, f"`{key}` {kind}, {SCHEMA}")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    place = 6

    def wanted(batches: Iterator[list]) -> Iterator[list[bool]]:
        for texts in batches:
            yield [measure(t)[place] for t in texts]

    return keep_rows(docs, text, wanted)
