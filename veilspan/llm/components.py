"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id in a link but the smallest ones.

    Rounds of large and small stars (Kiveris et al., 2014): every id is linked to the
    smallest neighbour it knows, on both sides in turn, until nothing changes; that takes
    about as many rounds as the logarithm of the longest path. Nothing is gathered by id,
    only minima are, so that an id with very many links is no special case. Each round is
    cut off from the one before by a checkpoint. Links of an id to itself and links with a
    null say nothing.
    """
    x, y = F.col(a), F.col(b)
    pairs = links.filter(x != y).select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    stars = cut(pairs.distinct())
    before = _state(stars)
    while before[0]:
        stars = cut(_round(stars))
        now = _state(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("hi").alias("id"), F.col("lo").alias("component"))


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())


def _round(stars: DataFrame) -> DataFrame:
    ends = stars.select(F.col("lo").alias("id"), F.col("hi").alias("other")).unionByName(
        stars.select(F.col("hi").alias("id"), F.col("lo").alias("other"))
    )
    least = ends.groupBy("id").agg(F.min("other").alias("other"))
    least = least.select(F.col("id").alias("lo"), F.least("id", "other").alias("least"))
    large = stars.join(least, "lo").select("hi", F.col("least").alias("lo")).distinct()
    smallest = large.groupBy("hi").agg(F.min("lo").alias("least"))
    small = large.join(smallest, "hi")
    return (
        small.select(F.col("least").alias("lo"), F.col("lo").alias("hi"))
        .unionByName(smallest.select(F.col("least").alias("lo"), "hi"))
        .filter("lo < hi")
        .distinct()
    )
