"""Joins that hold up when tables grow or one key owns much of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 8 * 1024 * 1024
SALTS = 32


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows of ``max_bytes`` together; reads no more rows than one beyond."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    row = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return row["n"] <= max_rows and (row["bytes"] or 0) <= max_bytes


def check_unique(table: DataFrame, key: str) -> None:
    """Refuse a lookup table in which a key stands twice: it would multiply the rows that meet it."""
    twice = table.groupBy(key).count().filter("count > 1").first()
    if twice:
        raise ValueError(f"the lookup table has {twice['count']} rows for {key} {twice[key]!r}")


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    spread_by: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``facts`` to a lookup table, whose keys are checked to be unique.

    The table is broadcast only if its rows and bytes prove few. Otherwise both
    sides shuffle on key and salt: the fact rows of a hot key are spread by a
    hash of ``spread_by`` and the table is repeated once per salt.
    """
    if how not in ("left", "inner"):
        raise ValueError("a lookup join is left or inner")
    check_unique(table, key)
    if is_small(table, max_rows):
        return facts.join(F.broadcast(table), key, how)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")
    repeated = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return facts.withColumn("__salt", salt).join(repeated, [key, "__salt"], how).drop("__salt")


def buckets_of(lo: Column, hi: Column, width: int | float) -> Column:
    """Numbers of the buckets that ``[lo, hi]`` touches."""
    return F.sequence(bucket_of(lo, width), F.greatest(bucket_of(lo, width), bucket_of(hi, width)))


def bucket_of(point: Column, width: int | float) -> Column:
    return F.floor(point / F.lit(width)).cast("long")


def join_within(left: DataFrame, right: DataFrame, on: list[str], inside: Column) -> DataFrame:
    """Left join on equal ``on`` columns where ``inside`` holds.

    ``inside`` is part of the join condition: left rows that meet no right row for
    which it holds come out once, with nulls.
    """
    for name in on:
        right = right.withColumnRenamed(name, f"__right_{name}")
    condition = inside
    for name in on:
        condition = condition & (F.col(name) == F.col(f"__right_{name}"))
    return left.join(right, condition, "left").drop(*[f"__right_{n}" for n in on])
