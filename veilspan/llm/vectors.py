"""Whole-number vectors, and how blocks of them meet: each block of one side with each stripe of the other.

A search of many queries in all rows is a grid of (block of queries, stripe of rows). Both have a
bounded number of rows, dealt out by key digests, so that no group grows with the data or with a
frequent vector; more data make more groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Rows of a block of queries and of a stripe of rows, about; a stripe has fewer where there would be few stripes.
BLOCK, STRIPE, LEAST_STRIPE = 2048, 1 << 17, 1 << 11
LONG = np.iinfo(np.int64).max


def scaled_vectors(df: DataFrame, vector: str, *columns: str, scale: float = SCALE) -> DataFrame:
    """Distinct rows of ``columns``, v (components as ``floor(scale * x)``) and its digests h1 and h2.

    Rows with a null vector, or with any component that is null or not finite (times ``scale``),
    are left out. Rows that repeat another in all of these count once. Larger components than a
    long can hold become the nearest one.
    """
    numbers = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    fits = F.forall(numbers, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    named = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)], F.when(fits, numbers).alias("x"))
    whole = named.filter("x IS NOT NULL").select("*", F.transform("x", lambda x: F.floor(x)).alias("v"))
    keyed = whole.select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    keys = [f"k{i}" for i in range(len(columns))]
    once = keyed.groupBy(*keys, "h1", "h2").agg(F.first("v").alias("v"))
    return once.select(*[F.col(k).alias(c) for k, c in zip(keys, columns, strict=True)], "h1", "h2", "v")


def _parts(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def grid(
    queries: DataFrame,
    rows: DataFrame,
    query_key: Column,
    row_key: Column,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """``work`` on each block of ``queries`` with each stripe of ``rows``, in tasks of their own.

    Both are read twice, to be counted and to be dealt out, and should be stored tables.
    """
    spark = queries.sparkSession
    n_queries, n_rows = queries.count(), rows.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = _parts(n_queries, BLOCK)
    n_stripes = max(_parts(n_rows, STRIPE), min(-(-tasks // n_blocks), _parts(n_rows, LEAST_STRIPE)))

    def dealt(df: DataFrame, key: Column, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select(
            "*", F.pmod(key, F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        ).groupBy("block", "stripe")

    left = dealt(queries, query_key, "block", n_blocks, "stripe", n_stripes)
    right = dealt(rows, row_key, "stripe", n_stripes, "block", n_blocks)
    return left.cogroup(right).applyInArrow(work, schema)


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """A row for each vector, in whole numbers; shorter ones are filled up with zeros, to ``width`` at least."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
        if isinstance(vectors, pa.ChunkedArray):
            vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], type=vectors.type)
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, dtype=np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and sizes.min() == width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def same_width(*matrices: np.ndarray) -> list[np.ndarray]:
    width = max(m.shape[1] for m in matrices)
    return [m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in matrices]


def largest(m: np.ndarray) -> int:
    """The largest absolute component."""
    return max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))


def to_long(scores: np.ndarray) -> np.ndarray:
    """Python's whole numbers as longs; what is beyond them becomes the nearest one."""
    if scores.dtype != object:
        return scores
    return np.clip(scores, -LONG - 1, LONG).astype(np.int64)
