"""Running totals over very long sequences, without a window or list over a whole one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, and buckets of a stretch of buckets.
WIDTH = 4096


def _with_total(left: DataFrame, totals: DataFrame, names: list[str], name: str) -> DataFrame:
    """``left`` with the total that its keys have in ``totals``."""
    own = totals.select(*[F.col(n).alias(f"__r_{n}") for n in names], name)
    met = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"__r_{n}")) for n in names])
    return left.join(own, met, "left").drop(*[f"__r_{n}" for n in names])


def _before(order: str, *keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running_offsets(
    df: DataFrame, keys: list[str], order: str, length: str, name: str = "offset", width: int = WIDTH
) -> DataFrame:
    """Add ``name``: the sum of ``length`` over all earlier rows of the same keys.

    ``order`` holds whole numbers from 0, each once for its keys; gaps are allowed. Rows are
    summed in buckets of ``width`` numbers, buckets in stretches of ``width`` buckets; what comes
    before a stretch is summed over stretches, of which there is one for every ``width``²
    numbers. Each window holds ``width`` rows at most, however long the sequence. Keys may be null.
    Null lengths count as zero.
    """
    size = F.coalesce(F.col(length).cast("long"), F.lit(0))
    rows = df.withColumn("__b", F.expr(f"`{order}` div {width}"))
    buckets = rows.groupBy(*keys, "__b").agg(F.sum(size).alias("__n"))
    buckets = buckets.withColumn("__s", F.expr(f"__b div {width}"))
    stretches = buckets.groupBy(*keys, "__s").agg(F.sum("__n").alias("__n"))
    earlier = stretches.select(*[F.col(k).alias(f"__e_{k}") for k in keys], F.col("__s").alias("__e_s"), F.col("__n").alias("__e_n"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__e_{k}")) for k in keys], F.col("__e_s") < F.col("__s"))
    carried = stretches.join(earlier, same, "left").groupBy(*keys, "__s").agg(F.sum("__e_n").alias("__carry"))
    inside = F.coalesce(F.sum("__n").over(_before("__b", *keys, "__s")), F.lit(0))
    starts = _with_total(buckets.withColumn("__inside", inside), carried, [*keys, "__s"], "__carry")
    starts = starts.select(*keys, "__b", (F.col("__inside") + F.coalesce("__carry", F.lit(0))).alias("__start"))
    local = F.coalesce(F.sum(size).over(_before(order, *keys, "__b")), F.lit(0))
    placed = _with_total(rows.withColumn("__local", local), starts, [*keys, "__b"], "__start")
    return placed.withColumn(name, F.col("__start") + F.col("__local")).drop("__b", "__local", "__start")


def flat_word_places(
    words: DataFrame, keys: list[str], order: str = "word_no", word: str = "word", before: str = "before", width: int = WIDTH
) -> DataFrame:
    """Add ``c0`` and ``c1``, the place of every word in its recording's text, from a flat table of words.

    ``before`` is the number of characters between a word and the one before it (the text's
    start, for the first). A recording may have any number of words. Null words have no place
    and take none beyond ``before``.
    """
    sized = words.withColumn("__size", F.coalesce(F.length(word), F.lit(0)) + F.coalesce(F.col(before), F.lit(0)))
    placed = running_offsets(sized, keys, order, "__size", "__at", width).drop("__size")
    c0 = F.when(F.col(word).isNotNull(), F.col("__at") + F.coalesce(F.col(before), F.lit(0)))
    return placed.withColumn("c0", c0).withColumn("c1", F.col("c0") + F.length(word)).drop("__at")
