"""Near-duplicate documents by SimHash, found with a table of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to a set of references. Near
fingerprints have near distances (the triangle inequality), which both finds the pairs and
discards most of them before they are verified.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts
from .components import components

SEED = 42
CHUNK = 1 << 16
#: Fingerprints link up to so many differing bits; the keys below hold for two.
BITS = 2
BLOCKS = 4
BLOCK_BITS = 16
REFERENCES_PER_BLOCK = 10
#: Beyond so many fingerprints under one key, links are found through shared neighbours.
LARGE_GROUP = 256


def fingerprint(raw: bytes | None, width: int = 3) -> int:
    """SimHash of a text's word shingles as a signed 64-bit number; 0 for a text without words."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``key`` and ``fp`` of every row; a null text has no words."""

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in batches:
            yield [keys, [fingerprint(t, width) for t in texts]]

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs, [key, text], work, f"`{key}` {kind}, fp long")


def references() -> list[list[int]]:
    """One reference, and for each block of bits others that differ from it in that block only."""
    draw = random.Random(SEED)
    first = draw.getrandbits(64)
    blocks = [
        [first ^ (draw.randrange(1, 1 << BLOCK_BITS) << (BLOCK_BITS * b)) for _ in range(REFERENCES_PER_BLOCK)]
        for b in range(BLOCKS)
    ]
    return [[first], *blocks]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _literal(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def pivot_table(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """``prints`` with ``at``: the Hamming distances to all references, the first reference first."""
    every = [r for group in references() for r in group]
    return prints.withColumn("at", F.array(*[distance(F.col(fp), _literal(r)).cast("tinyint") for r in every]))


def _keys() -> Column:
    """What near fingerprints share, from their distances alone.

    The distance to a reference less that to the first one depends only on the bits of the
    block in which the two references differ. Two bits lie in two of the four blocks at
    most, so fingerprints that differ in two bits agree on all these differences in at
    least two blocks.
    """
    at = F.col("at")

    def block(b: int) -> list[Column]:
        first = 1 + b * REFERENCES_PER_BLOCK
        return [(at[i] - at[0]).cast("tinyint") for i in range(first, first + REFERENCES_PER_BLOCK)]

    pairs = enumerate(combinations(range(BLOCKS), 2))
    return F.array(*[F.xxhash64(F.lit(i), *block(a), *block(b)) for i, (a, b) in pairs])


def near_links(prints: DataFrame) -> DataFrame:
    """Links that connect all of ``prints`` (``id``, distinct ``fp``) that differ in at most ``BITS`` bits.

    Fingerprints meet on what their distance tables share, pairs of which any distance
    differs by more than ``BITS`` are discarded, the rest are compared. A key with more
    than ``LARGE_GROUP`` fingerprints is not expanded into pairs: its members meet in the
    fingerprints one bit away (two that differ in two bits share such a neighbour), and
    each is linked to the smallest id there.
    """
    keyed = pivot_table(prints).withColumn("key", F.explode(_keys()))
    large = cut(keyed.groupBy("key").count().filter(F.col("count") > LARGE_GROUP).select("key"))
    small = keyed.join(large, "key", "left_anti")
    a, b = small.alias("a"), small.alias("b")
    coordinates = F.zip_with(F.col("a.at"), F.col("b.at"), lambda x, y: F.abs(x - y))
    pairs = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.array_max(coordinates) <= BITS)
        & (distance(F.col("a.fp"), F.col("b.fp")) <= BITS),
    ).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    if large.isEmpty():
        return pairs
    crowded = keyed.join(large, "key", "left_semi").select("id", "fp").distinct()
    near = F.array(*[F.col("fp").bitwiseXOR(_literal(s)) for s in (0, *(1 << i for i in range(64)))])
    met = crowded.select("id", F.explode(near).alias("meeting"))
    smallest = met.groupBy("meeting").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = met.join(smallest, "meeting").select(F.col("id").alias("a"), "b").filter("a != b").distinct()
    return pairs.unionByName(stars)


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``key``, ``fingerprint`` (hex) and ``component_id`` of every row of ``docs``.

    The component is the smallest key that can be reached through fingerprints at most
    ``BITS`` bits apart, the row's own included. Null and empty texts have fingerprint zero
    and link like others. Rows that repeat a key or a text share a fingerprint and so a
    component. Rows without a key have a fingerprint, link nothing and have the component
    of their fingerprint, null if no row with a key shares it. An empty table gives an
    empty one; other columns are not read.

    Copies meet in one row per fingerprint, reduced before the shuffle; links, stars and
    labels hold distinct fingerprints only.
    """
    rows = cut(fingerprints(docs, key, text, width).select(F.col(key).alias("key"), "fp"))
    prints = cut(rows.filter("key IS NOT NULL").groupBy("fp").agg(F.min("key").alias("id")))
    found = components(near_links(prints), "a", "b")
    labels = prints.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(labels, "fp", "left").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with one document of each component: the one whose key is the component's.

    Rows that repeat that key all stay, as do rows without a key.
    """
    spare = simhash_components(docs, key, text, width).filter(F.col("component_id") != F.col(key))
    return docs.join(spare.select(key).distinct(), key, "left_anti")
