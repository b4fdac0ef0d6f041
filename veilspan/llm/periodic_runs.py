"""Periodic stretches of a text: all maximal runs of words, found in its enhanced suffix array.

Texts of a batch stand one after the other, with words numbered apart for each text, so that
one suffix array serves them all and no match reaches over a border. A square (two equal
stretches in a row) that cannot be moved to the right shows in the array: its two halves begin
with suffixes that lie in different children of the interval whose depth is the period. For
each interval, the suffixes of all children but the largest look up where the suffix one period
on, and one period back, lies. Squares are then rotated left as far as they go, which gives
the runs. All steps are numpy operations over the whole batch: no tree, no stack, no loop over
suffixes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Words that are sorted at a time, if a single text does not have more.
BATCH_WORDS = 1 << 17
#: Suffixes of smaller children that are looked up at a time.
STEP = 1 << 20

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class SuffixArray:
    """Suffixes in order, with what was learnt on the way: ranks by the first 1, 2, 4, ... words.

    ``ranks[t][i]`` is equal for positions i at which the same 2^t words follow; ``apart[k]`` is
    the round that told suffixes k - 1 and k apart, which share 2^(round - 1) words or more, but
    not twice as many (round 0: none).
    """

    def __init__(self, words: np.ndarray) -> None:
        n = self.n = len(words)
        self.order = np.argsort(words, kind="stable")
        ranked = words[self.order]
        head = np.ones(n, dtype=bool)
        head[1:] = ranked[1:] != ranked[:-1]
        self.apart = np.zeros(n, dtype=np.int8)
        rank = np.full(n + 1, -1, dtype=np.int64)
        rank[self.order] = np.flatnonzero(head)[np.cumsum(head) - 1]
        self.ranks = [rank]
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
        while len(open_):
            rank = rank.copy()
            reach = 1 << len(self.ranks) - 1
            at = self.order[open_]
            group = rank[at]
            key = group * (n + 1) + rank[np.minimum(at + reach, n)] + 1
            by_key = np.argsort(key, kind="stable")
            at, key = at[by_key], key[by_key]
            self.order[open_] = at
            head = np.ones(len(open_), dtype=bool)
            head[1:] = key[1:] != key[:-1]
            new = head.copy()
            new[1:] &= group[1:] == group[:-1]
            new[0] = False
            self.apart[open_[new]] = len(self.ranks)
            rank[at] = open_[np.flatnonzero(head)[np.cumsum(head) - 1]]
            self.ranks.append(rank)
            open_ = open_[~(head & np.append(head[1:], True))]

    def shared(self, k: np.ndarray) -> np.ndarray:
        """How many words suffixes k - 1 and k share."""
        rounds = self.apart[k].astype(np.int64)
        length = np.where(rounds > 0, 1 << np.maximum(rounds - 1, 0), 0)
        a, b = self.order[k - 1], self.order[k]
        for t in range(int(rounds.max(initial=0)) - 2, -1, -1):
            some = np.flatnonzero(rounds - 2 >= t)
            x, y = a[some] + length[some], b[some] + length[some]
            length[some[self.ranks[t][x] == self.ranks[t][y]]] += 1 << t
        return length

    def shared_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before positions a and b (a < b) are equal."""
        a, length = a.copy(), np.zeros(len(a), dtype=np.int64)
        apart = b - a
        for t in range(len(self.ranks) - 1, -1, -1):
            back = a - (1 << t)
            at = np.maximum(back, 0)
            same = (back >= 0) & (self.ranks[t][at] == self.ranks[t][at + apart])
            length[same] += 1 << t
            a[same] = back[same]
        return length


def _smaller_than(values: np.ndarray, k: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places before and after ``k`` with a value less than that at ``k``.

    Minima of stretches of 1, 2, 4, ... values let each place walk in ever smaller steps.
    """
    n, least = len(values), [values]
    while 1 << len(least) <= widest:
        half = 1 << len(least) - 1
        last = least[-1]
        wide = last.copy()
        wide[: n - half] = np.minimum(last[: n - half], last[half:])
        least.append(wide)
    own, left, right = values[k], k.copy(), k + 1
    for t in range(len(least) - 1, -1, -1):
        back = left - (1 << t)
        go = (back >= 0) & (least[t][np.maximum(back, 0)] >= own)
        left[go] = back[go]
        go = (right + (1 << t) <= n) & (least[t][np.minimum(right, n - 1)] >= own)
        right[go] += 1 << t
    return left - 1, right


def _kept(found: SuffixArray, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, without those whose first word begins no match of ``needed`` words, and shared lengths."""
    heads = np.flatnonzero(found.apart == 0)
    sizes = np.diff(np.append(heads, found.n))
    # a round r means at most 2^r - 1 shared words
    wanted = (1 << np.maximum.reduceat(found.apart, heads).astype(np.int64)) - 1 >= needed
    where = np.flatnonzero(np.repeat(wanted, sizes))
    length = np.zeros(len(where), dtype=np.int64)
    inner = np.flatnonzero(found.apart[where] > 0)
    length[inner] = found.shared(where[inner])
    return found.order[where], length


def branching_squares(found: SuffixArray, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares that cannot move to the right, inside matches of ``needed`` words."""
    nothing = np.zeros(0, dtype=np.int64)
    order, length = _kept(found, needed)
    if not len(order):
        return nothing, nothing
    m = len(order)
    place = np.full(found.n + 1, -1, dtype=np.int64)
    place[order] = np.arange(m)
    borders = np.flatnonzero(length > 0)
    clusters = np.append(np.flatnonzero(length == 0), m)
    low, high = _smaller_than(length, borders, int(np.diff(clusters).max()))
    by_interval = np.lexsort((borders, high, low))
    borders, low, high = borders[by_interval], low[by_interval], high[by_interval]
    first = np.ones(len(borders), dtype=bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    interval = np.cumsum(first) - 1
    at = np.flatnonzero(first)

    # children of an interval: from its start to the first border, from border to border, to its end
    n_children = len(borders) + len(at)
    starts, of = np.empty(n_children, dtype=np.int64), np.empty(n_children, dtype=np.int64)
    inner, outer = np.arange(len(borders)) + interval + 1, at + np.arange(len(at))
    starts[inner], starts[outer] = borders, low[at]
    of[inner], of[outer] = interval, np.arange(len(at))
    ends = np.append(starts[1:], 0)
    ends[np.append(outer[1:], n_children) - 1] = high[at]
    sizes = ends - starts
    largest = np.flatnonzero(sizes == np.maximum.reduceat(sizes, outer)[of])
    once = np.ones(len(largest), dtype=bool)
    once[1:] = of[largest[1:]] != of[largest[:-1]]
    smaller = np.delete(np.arange(n_children), largest[once])

    depth, low, high = length[borders[at]], low[at], high[at]
    done = np.cumsum(sizes[smaller])
    squares = []
    for a, b in _steps(done):
        child = np.repeat(smaller[a:b], sizes[smaller[a:b]])
        offset = np.arange(len(child)) - np.repeat(done[a:b] - sizes[smaller[a:b]], sizes[smaller[a:b]])
        offset += done[a - 1] if a else 0
        i, period, own = order[starts[child] + offset], depth[of[child]], of[child]
        for other, start in ((i + period, i), (i - period, i - period)):
            p = place[np.where((other >= 0) & (other < found.n), other, found.n)]
            inside = (p >= low[own]) & (p < high[own]) & ~((p >= starts[child]) & (p < ends[child]))
            squares.append(np.stack([start[inside], period[inside]]))
    start, period = np.unique(np.concatenate(squares, axis=1), axis=1) if squares else (nothing, nothing)
    return start, period


def _steps(done: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of children that hold about ``STEP`` suffixes together."""
    a = 0
    while a < len(done):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + STEP)))
        yield a, b
        a = b


def find_runs(
    words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs among numbered words, in order of start, then period.

    Runs have ``min_length`` words and ``min_exponent`` (2 or more) times their period or more.
    """
    if not len(words):
        return (np.zeros(0, dtype=np.int64),) * 3
    # the first two periods of a run match over all of it but one period
    needed = min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, max(min_length, 1) + 1))
    found = SuffixArray(words)
    start, period = branching_squares(found, needed)
    end = start + 2 * period
    start = start - found.shared_before(start, start + period)
    fits = end - start >= np.maximum(min_length, min_exponent * period)
    start, end, period = start[fits], end[fits], period[fits]
    # multiples of a period give the same stretch
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, length, period = start[first], (end - start)[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _batches(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        words = (text or b"").split()
        if held and size + len(words) > BATCH_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _work(texts: list[list[bytes]], min_length: int, min_exponent: int) -> Iterator[tuple[int, list[dict], bytes]]:
    """Number of words, runs and the rest of each text."""
    numbers = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    ids = np.fromiter((numbers[w] for words in texts for w in words), dtype=np.int64, count=int(sizes.sum()))
    ids += np.repeat(np.arange(len(texts)) * (len(numbers) + 1), sizes)
    start, length, period = find_runs(ids, min_length, min_exponent)
    of = np.searchsorted(ends, start, side="right")
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for d, words in enumerate(texts):
        a, b = bounds[d], bounds[d + 1]
        if a == b:
            yield len(words), [], b" ".join(words)
            continue
        own = start[a:b] - (ends[d] - sizes[d])
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, own + period[a:b], 1)
        np.add.at(change, own + length[a:b], -1)
        stays = np.cumsum(change[:-1]) == 0
        rest = b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s)
        runs = zip(own.tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)
        yield len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs], rest


def periodic_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_words, ``runs`` and ``collapsed``.

    ``runs`` are the stretches of words with a smallest period, of ``min_length`` words and
    ``min_exponent`` periods or more, that no neighbouring word extends, by start, then period;
    words are numbered from 0. ``collapsed`` is the text with the first period of each run only,
    its words joined by one space. Null and empty texts have no words, no runs and an empty rest.
    Rows that repeat a key give a row each, a null key is kept, ties do not arise, an empty
    table gives an empty one, and other columns are not read. No shuffle: whole texts are
    searched where they are read, in time near linear in their words.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least once")

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in batches:
            at = 0
            for part in _batches(texts):
                found = list(_work(part, min_length, min_exponent))
                yield [keys[at : at + len(part)], *map(list, zip(*found, strict=True))]
                at += len(part)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, runs array<{RUN}>, collapsed binary"
    return map_texts(docs, [key, text], work, schema).withColumn("collapsed", F.col("collapsed").cast("string"))
