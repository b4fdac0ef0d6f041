"""Exact top-k search by a vector-approximation file (Weber, Schek, Blott, 1998).

Every distinct vector gets a byte per component: the cell it lies in. A scan of the cells alone
bounds the score of each vector for each query from below and above. Only vectors whose upper
bound reaches the kth lower bound are then read exactly, the best bounds first; once the kth score
is known, only those whose upper bound reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import SCALE, grid, largest, matrix, same_width, scaled_vectors, to_long

CELLS = 256
#: Vectors that the borders of the cells are learnt from, those with the smallest digests; all are indexed.
SAMPLE = 8192
#: Queries and rows whose bounds are worked out at a time.
TILE = (256, 1 << 13)
#: Below this, sums of products of whole numbers are exact in doubles.
EXACT = 1 << 52


class Cells:
    """Borders of the cells of each component: ``low[j, c]`` to ``high[j, c]``, both inside."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        d = len(least)
        self.low = np.empty((d, CELLS), dtype=np.int64)
        self.high = np.empty((d, CELLS), dtype=np.int64)
        for j in range(d):
            ranked = np.sort(sample[:, j]) if j < sample.shape[1] else np.zeros(len(sample), dtype=np.int64)
            marks = np.unique(ranked[np.arange(1, CELLS) * len(ranked) // CELLS]) if len(ranked) else ranked
            marks = marks[(marks > least[j]) & (marks <= most[j])]
            starts = np.append(least[j], marks)
            ends = np.append(marks - 1, most[j])
            self.low[j], self.high[j] = starts[-1], ends[-1]
            self.low[j, : len(starts)], self.high[j, : len(ends)] = starts, ends
        self.width = d

    def code(self, vectors: np.ndarray) -> np.ndarray:
        """Cell numbers, a byte each."""
        out = np.empty(vectors.shape, dtype=np.uint8)
        for j in range(vectors.shape[1]):
            n = 1 + int(np.count_nonzero(self.low[j, 1:] > self.low[j, :-1]))
            out[:, j] = np.searchsorted(self.low[j, :n], vectors[:, j], side="right") - 1
        return out

    def borders(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(self.width)[None, :]
        return self.low[at, codes], self.high[at, codes]


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products of each query with any vector between ``low`` and ``high``."""
    up, down = (np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64))
    low_f, high_f = low.astype(np.float64).T, high.astype(np.float64).T
    least, most = up @ low_f + down @ high_f, up @ high_f + down @ low_f
    if queries.shape[1] * max(largest(low), largest(high)) * largest(queries) >= EXACT:
        spare = (up - down) @ np.maximum(np.abs(low_f), np.abs(high_f)) * 1e-12
        # scores end at 2**63 - 1, which no double is: the next smaller one bounds them from below
        least, most = np.clip(least - spare, -(2.0**63), np.nextafter(2.0**63, 0)), np.clip(most + spare, -(2.0**63), 2.0**63)
    return least, most


def _scan(cells: Cells, size: int):
    """For a block and a stripe: rows that could be among the ``size`` best of a query, with their bounds."""

    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        kept: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and rows.num_rows:
            q = np.pad(m := matrix(queries["v"]), ((0, 0), (0, cells.width - m.shape[1])))
            codes = np.frombuffer(b"".join(rows["cells"].to_pylist()), dtype=np.uint8)
            codes = codes.reshape(rows.num_rows, cells.width)
            certain = np.full((len(q), size), -np.inf)
            for j in range(0, len(codes), TILE[1]):
                low, high = cells.borders(codes[j : j + TILE[1]])
                for i in range(0, len(q), TILE[0]):
                    own = slice(i, i + TILE[0])
                    least, most = bounds(q[own], low, high)
                    best = np.concatenate([certain[own], _highest(least, size)], axis=1)
                    certain[own] = _highest(best, size)
                    r, c = np.nonzero(most >= certain[own].min(axis=1)[:, None])
                    kept.append((r + i, c + j, least[r, c], most[r, c]))
            r, c, least, most = (np.concatenate(x) for x in zip(*kept, strict=True))
            still = most >= certain.min(axis=1)[r]
            kept = [(r[still], c[still], least[still], most[still])]
        r, c, least, most = kept[0] if kept else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),) * 2
        a, b = queries.select(["h1", "h2"]).take(pa.array(r)), rows.select(["h1", "h2"]).take(pa.array(c))
        return pa.table({"q1": a["h1"], "q2": a["h2"], "h1": b["h1"], "h2": b["h2"], "least": least, "most": most})

    return work


def _highest(values: np.ndarray, size: int) -> np.ndarray:
    n = values.shape[1]
    return values if n <= size else np.partition(values, n - size, axis=1)[:, n - size :]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest value of each component in a task, zeros included if vectors differ in length."""
    least = most = np.zeros((0, 0), dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            m = matrix(batch.column(0))
            least, low = same_width(least, m.min(axis=0, keepdims=True))
            most, high = same_width(most, m.max(axis=0, keepdims=True))
            least = np.concatenate([least, low]).min(axis=0, keepdims=True)
            most = np.concatenate([most, high]).max(axis=0, keepdims=True)
    least, most = least.ravel(), most.ravel()
    yield pa.RecordBatch.from_pydict(
        {
            "j": pa.array(np.arange(len(least)), type=pa.int64()),
            "least": pa.array(least, type=pa.int64()),
            "most": pa.array(most, type=pa.int64()),
        }
    )


def learn_cells(vectors: DataFrame) -> Cells:
    """Cells from a bounded sample; the outermost reach as far as any vector does.

    A row for each component comes to the driver, and ``SAMPLE`` vectors.
    """
    ranges = vectors.select("v").mapInArrow(_ranges, "j long, least long, most long")
    found = ranges.groupBy("j").agg(F.min("least").alias("least"), F.max("most").alias("most")).orderBy("j").collect()
    sample = vectors.orderBy("h1", "h2").limit(SAMPLE).select("v").toArrow()
    same = vectors.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    zero = same[0] != same[1]  # the shorter ones go on with zeros
    least = np.array([min(r.least, 0) if zero else r.least for r in found], dtype=np.int64)
    most = np.array([max(r.most, 0) if zero else r.most for r in found], dtype=np.int64)
    return Cells(matrix(sample["v"], len(least)), least, most)


def approximate(vectors: DataFrame, cells: Cells) -> DataFrame:
    """h1, h2 and ``cells``, the bytes of the approximation, of every vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = cells.code(matrix(batch.column(2), cells.width))
            rows = [c.tobytes() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, type=pa.binary())], names=["h1", "h2", "cells"])

    return vectors.select("h1", "h2", "v").mapInArrow(work, "h1 long, h2 long, cells binary")


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """q1, q2, h1, h2 and the ``score`` of pairs, from the exact vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = same_width(matrix(batch.column(4)), matrix(batch.column(5)))
            if a.shape[1] * largest(a) * largest(b) >= 1 << 62:
                a, b = a.astype(object), b.astype(object)
            score = to_long((a * b).sum(axis=1)) if a.shape[1] else np.zeros(len(a), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(score, type=pa.int64())], names=["q1", "q2", "h1", "h2", "score"])

    own = vectors.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("v").alias("x"))
    both = pairs.join(vectors, ["h1", "h2"]).join(own, ["q1", "q2"])
    return both.select("q1", "q2", "h1", "h2", "x", "v").mapInArrow(
        work, "q1 long, q2 long, h1 long, h2 long, score long"
    )


def _best_vectors(queries: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """q1, q2, h1, h2, score: all vectors that could be among the ``size`` best of a query vector."""
    cells = learn_cells(vectors)
    approximations = stored(approximate(vectors, cells), "approximations")
    schema = "q1 long, q2 long, h1 long, h2 long, least double, most double"
    found = stored(grid(queries, approximations, F.col("h1"), F.col("h1"), _scan(cells, size), schema), "bounds")

    query = Window.partitionBy("q1", "q2")
    lows = found.withColumn("n", F.row_number().over(query.orderBy(F.desc("least")))).filter(F.col("n") <= size)
    certain = lows.groupBy("q1", "q2").agg(F.min("least").alias("certain"))
    open_ = stored(found.join(certain, ["q1", "q2"]).filter("most >= certain"), "candidates")
    # the best bounds first: they settle the kth score, which most of the others cannot reach
    place = F.row_number().over(query.orderBy(F.desc("most"), "h1", "h2"))
    first = stored(_exact(open_.withColumn("n", place).filter(F.col("n") <= size), vectors), "first-read")
    settled = first.groupBy("q1", "q2").agg(F.min("score").alias("score"))
    rest = open_.join(settled, ["q1", "q2"]).filter("most >= score").drop("score")
    rest = rest.join(first.select("q1", "q2", "h1", "h2"), ["q1", "q2", "h1", "h2"], "left_anti")
    return first.unionByName(_exact(rest, vectors))


def exact_top_k(
    df: DataFrame,
    is_query: str,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    scale: float = SCALE,
) -> DataFrame:
    """query_id, rank (from 1), the candidate's key and score: the ``k`` best rows of each query.

    Queries are the rows for which the SQL condition ``is_query``, on ``key``, is true; candidates
    are all rows but the query's own. Components become ``floor(scale * x)``; scores are inner
    products, higher ones first, ties by smaller key.

    Rows with a null key, a null vector, or a null or infinite component take no part. Rows
    repeated in key and vector count once; one key with several vectors is several rows. Vectors that occur many times are searched once, and
    stand for their k + 1 smallest keys, as no other can be among a query's k best. Shorter
    vectors go on with zeros. Scores beyond a long count as the nearest one. Without queries, or
    rows, there is no result. Other columns are not read.
    """
    asked = F.coalesce(F.expr(is_query), F.lit(False)).alias("asked")
    chosen = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"), asked).filter("id IS NOT NULL")
    rows = stored(scaled_vectors(chosen, "x", "id", "asked", scale=scale), "vectors")
    vectors = stored(rows.groupBy("h1", "h2").agg(F.first("v").alias("v")), "distinct-vectors")
    size = k + 1  # a query's own row is one of them
    same = Window.partitionBy("h1", "h2").orderBy("id")
    ids = rows.select("h1", "h2", "id", F.row_number().over(same).alias("n")).filter(F.col("n") <= size).drop("n")
    queries = rows.filter("asked").select(F.col("id").alias("query_id"), "h1", "h2")
    sought = stored(vectors.join(queries.select("h1", "h2").distinct(), ["h1", "h2"]), "query-vectors")

    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id", "h1", "h2")
    found = _best_vectors(sought, vectors, size).join(ids, ["h1", "h2"])
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= size)
    own = queries.withColumnsRenamed({"h1": "q1", "h2": "q2"})
    ranked = own.join(top, ["q1", "q2"]).filter("NOT (id = query_id AND h1 = q1 AND h2 = q2)")
    order = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "id", "h1", "h2")
    return (
        ranked.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(key), "score")
    )
