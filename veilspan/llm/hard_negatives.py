"""Hard negatives: rows of other labels that score within a window below an anchor's best rows of its own.

Scores are inner products of whole numbers, from a recursive multiplication (Strassen, 1969) of
tiles of anchors and candidates. Tiles of candidates pass by; what is kept for an anchor are heaps
of fixed size, which merge: within a task from tile to tile, then from task to task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import LONG, SCALE, grid, largest, matrix, same_width, scaled_vectors, to_long

#: A tile is split no further once a side is as small as this.
LEAF = 32
#: Anchors and candidates of a tile.
TILE = (256, 1 << 14)
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 62


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A plain product; by doubles where all sums are whole numbers that a double holds exactly."""
    if a.dtype != object and a.shape[1] * largest(a) * largest(b) < EXACT_DOUBLE:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(m: np.ndarray) -> np.ndarray:
    """``m`` with zeros in a further row or column where it has an odd number."""
    n, k = m.shape
    if n % 2 == k % 2 == 0:
        return m
    out = np.zeros((n + n % 2, k + k % 2), dtype=m.dtype)
    out[:n, :k] = m
    return out


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of whole-number matrices by seven half-size products a level, exactly.

    Odd sides get a row or column of zeros. Only additions, subtractions and products of whole
    numbers are used.
    """
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= LEAF:
        return _leaf(a, b)
    a, b = _even(a), _even(b)
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * r, 2 * t), dtype=p1.dtype)
    out[:r, :t] = p1 + p4 - p5 + p7
    out[:r, t:] = p3 + p5
    out[r:, :t] = p2 + p4
    out[r:, t:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, as longs."""
    # a level doubles the terms of both sides and adds up to four products
    grown = 16 ** max(0, (min(len(a), a.shape[1], len(b)) - 1).bit_length() - LEAF.bit_length() + 1)
    if a.shape[1] * largest(a) * largest(b) * grown >= EXACT_LONG:
        return to_long(strassen(a.astype(object), b.astype(object).T))
    return strassen(a, b.T)


def _best(group: np.ndarray, score: np.ndarray, id_: np.ndarray, size: int) -> np.ndarray:
    """Places of the ``size`` highest scores of each group, ties by smaller id, in order."""
    order = np.lexsort((id_, -score, group))
    ranked = group[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, dtype=int)
    rank = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
    return order[rank < size]


class Heaps:
    """The highest ``size`` (score, id) of each of ``n`` groups so far."""

    def __init__(self, n: int, size: int) -> None:
        self.size = size
        self.group, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        #: Less than this can no longer get into a group's heap.
        self.least = np.full(n, -LONG - 1, dtype=np.int64)

    def merge(self, group: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(group):
            return
        group, score, id_ = (
            np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, id_))
        )
        kept = _best(group, score, id_, self.size)
        self.group, self.score, self.id = group[kept], score[kept], id_[kept]
        full = np.bincount(self.group, minlength=len(self.least)) == self.size
        last = np.append(self.group[1:] != self.group[:-1], True)
        least = np.full(len(self.least), -LONG - 1, dtype=np.int64)
        least[self.group[last]] = self.score[last]
        self.least = np.where(full, least, self.least)


def _tiles(x: np.ndarray, y: np.ndarray):
    """Tiles of anchors ``x`` and candidates ``y``: narrow ones first, which fill the heaps."""
    for i in range(0, len(x), TILE[0]):
        j, wide = 0, TILE[1] // 8
        while j < len(y):
            yield x[i : i + TILE[0]], y[j : j + wide]
            j, wide = j + wide, min(2 * wide, TILE[1])


ANCHOR = ["id", "label", "h1", "h2"]


def _table(anchors: pa.Table, of: np.ndarray, **columns) -> pa.Table:
    """The anchors' keys at places ``of``, and further columns."""
    keys = anchors.select(ANCHOR).take(pa.array(of, type=pa.int64()))
    return pa.table({**{k: keys[k] for k in ANCHOR}, **columns})


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return matrix(table["v"]), table["id"].to_numpy(), table["label"].to_numpy()


def _equal(anchors: pa.Table, rows: pa.Table, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows ``y`` are the anchors ``x`` themselves."""
    same = [anchors[k].to_numpy()[x][:, None] == rows[k].to_numpy()[y][None, :] for k in ("id", "h1", "h2")]
    return same[0] & same[1] & same[2]


def _positives(size: int):
    """For a block and a stripe: the best candidates of each anchor's label."""

    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        heaps = Heaps(anchors.num_rows, size)
        if anchors.num_rows and rows.num_rows:
            (a, _, own_labels), (b, ids, labels) = _read(anchors), _read(rows)
            a, b = same_width(a, b)
            by_label = np.argsort(labels, kind="stable")
            theirs = labels[by_label]
            for label in np.unique(own_labels):
                mine = np.flatnonzero(own_labels == label)
                like = by_label[np.searchsorted(theirs, label) : np.searchsorted(theirs, label, side="right")]
                for x, y in _tiles(mine, like):
                    score = products(a[x], b[y])
                    allowed = ~_equal(anchors, rows, x, y)
                    least = heaps.least[x]
                    if len(y) > size:
                        # ties of the last place are told apart by id, in the heaps
                        here = np.partition(np.where(allowed, score, -LONG - 1), len(y) - size, axis=1)
                        least = np.maximum(least, here[:, len(y) - size])
                    r, c = np.nonzero(allowed & (score >= least[:, None]))
                    heaps.merge(x[r], score[r, c], ids[y[c]])
        return _table(anchors, heaps.group, positive_id=heaps.id, positive_score=heaps.score)

    return work


def _share(score: np.ndarray, per_cent: int, up: bool) -> np.ndarray:
    """So many per cent of whole numbers, rounded up or down, without leaving the range of a long."""
    q, r = np.divmod(score, 100)
    return per_cent * q + (-(-per_cent * r // 100) if up else per_cent * r // 100)


def _negatives(size: int, n_positives: int, low: int, high: int):
    """For a block and a stripe: the best candidates of other labels in each positive's window."""

    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        positives = matrix(anchors["scores"], n_positives)
        n = np.diff(anchors["scores"].combine_chunks().offsets.to_numpy()) if anchors.num_rows else np.zeros(0, int)
        real = np.arange(n_positives)[None, :] < n[:, None]
        floor = np.where(real, _share(positives, low, True), LONG)
        ceiling = np.where(real, _share(positives, high, False), -LONG)
        heaps = Heaps(anchors.num_rows * n_positives, size)
        if anchors.num_rows and rows.num_rows:
            (a, _, own_labels), (b, ids, labels) = _read(anchors), _read(rows)
            a, b = same_width(a, b)
            top = ceiling.max(axis=1)
            for x, y in _tiles(np.arange(len(a)), np.arange(len(b))):
                score = products(a[x], b[y])
                lows = np.maximum(floor, heaps.least.reshape(-1, n_positives))[x]
                inside = (score >= lows.min(axis=1)[:, None]) & (score <= top[x][:, None])
                r, c = np.nonzero(inside & (own_labels[x][:, None] != labels[y][None, :]))
                value = score[r, c]
                fits = (value[:, None] >= lows[r]) & (value[:, None] <= ceiling[x][r])
                e, p = np.nonzero(fits)
                heaps.merge(x[r[e]] * n_positives + p, value[e], ids[y[c[e]]])
        of, place = np.divmod(heaps.group, n_positives)
        return _table(anchors, of, place=place.astype(np.int32), negative_id=heaps.id, negative_score=heaps.score)

    return work


def hard_negatives(
    df: DataFrame,
    is_anchor: str,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which the SQL condition ``is_anchor``, on ``key``, is true. Components become
    ``floor(scale * x)``, scores are inner products; higher ones come first, ties by smaller key.
    An anchor's positives are its first ``n_positives`` other rows of the same label. For each,
    the first ``n_negatives`` rows of other labels that score between ``low`` and ``high`` per
    cent of the positive's score are returned, ranked from 1; fewer where there are fewer.

    Rows with a null key or label, a null vector, or a null or infinite component take no part.
    Rows repeated in key, label and vector count once; one key with several labels or vectors is
    several rows. Shorter vectors go on with zeros, empty ones are all zeros. Scores beyond a long
    count as the nearest one. A table without anchors, or an empty one, gives no rows. Other
    columns are not read.
    """
    asked = F.coalesce(F.expr(is_anchor), F.lit(False)).alias("asked")
    named = [F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("x")]
    kept = df.select(*named, asked).filter("id IS NOT NULL AND label IS NOT NULL")
    rows = stored(scaled_vectors(kept, "x", "id", "label", "asked", scale=scale), "vectors")
    anchors = rows.filter("asked")
    block, stripe = F.xxhash64(*ANCHOR), F.xxhash64(F.lit(1), *ANCHOR)
    own = "id long, label long, h1 long, h2 long"

    found = grid(anchors, rows, block, stripe, _positives(n_positives), f"{own}, positive_id long, positive_score long")
    best = Window.partitionBy(*ANCHOR).orderBy(F.desc("positive_score"), "positive_id")
    ranked = found.withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < n_positives)
    pairs = stored(ranked, "positives")

    scores = F.transform(
        F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]
    )
    windows = stored(anchors.join(pairs.groupBy(*ANCHOR).agg(scores.alias("scores")), ANCHOR), "windows")
    work = _negatives(n_negatives, n_positives, low, high)
    near = grid(windows, rows, block, stripe, work, f"{own}, place int, negative_id long, negative_score long")
    best = Window.partitionBy(*ANCHOR, "place").orderBy(F.desc("negative_score"), "negative_id")
    top = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n_negatives)
    return top.join(pairs, [*ANCHOR, "place"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
