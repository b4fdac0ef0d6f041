"""One of each group of documents with nearly the same text, by five-word shingles.

Texts whose SimHash prints differ by two bits at most meet by the prints' distances to references, as
in ``simhash_dedup``. Prints of documents at a similarity of 0.8 differ by about ten of 64 bits, more
than they can be keyed by. So texts further apart meet by bands of min-hashes, pairs beyond
``RADIUS`` bits are discarded. All pairs are verified by their shingles.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from .common import cut, map_texts
from .components import components

SEED = 42
WIDTH = 5
#: Texts link if they share four fifths of their distinct shingles.
SHARED, OF = 4, 5
#: Prints at the limit are 9.7 bits apart on average, with a deviation of 2.9.
RADIUS = 22
#: A pair at the limit misses all bands once in 38,000 times: (1 - 0.8^4)^20.
BANDS, ROWS = 20, 4
CHUNK = 1 << 12

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)
_draw = random.Random(SEED)
_ODD = np.array([_draw.getrandbits(64) | 1 for _ in range(BANDS * ROWS)], dtype=np.uint64)[:, None]
_ADD = np.array([_draw.getrandbits(64) for _ in range(BANDS * ROWS)], dtype=np.uint64)[:, None]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> _SHIFT) * _MIX
    values = (values ^ values >> _SHIFT) * _BASE
    return values ^ values >> _SHIFT


def shingles(raw: bytes | None) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order; a text of fewer words is one shingle."""
    words = (raw or b"").lower().split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    values = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in seen), dtype=np.uint64, count=len(seen))[ids]
    width = min(WIDTH, len(words))
    runs = np.full(max(1, len(words) - WIDTH + 1), width, dtype=np.uint64)
    for i in range(width):
        runs = _mixed(runs * _BASE + values[i : i + len(runs)])
    return np.unique(runs)


def sketch(raw: bytes | None) -> tuple[bytes, int, int, np.ndarray]:
    """Digest and number of a text's shingles, their SimHash, and the keys of its bands."""
    runs = shingles(raw)
    counts, least = np.zeros(64, dtype=np.int64), np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(runs), CHUNK):
        part = runs[at : at + CHUNK]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
        np.minimum(least, _mixed(part * _ODD + _ADD).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _BASE + row)
    sim = int(np.packbits(2 * counts > len(runs), bitorder="little").view("<i8")[0])
    return xxhash.xxh3_128_digest(runs.tobytes()), len(runs), sim, keys.view(np.int64)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, dtype=np.int64), *arrays]))


def sketches(rows: DataFrame) -> DataFrame:
    """``key``, ``h`` and the sketch of every row's ``body``."""

    def work(batches: Iterator[list[list]]) -> Iterator[list]:
        for keys, hashes, texts in batches:
            found = [sketch(t) for t in texts]
            yield [keys, hashes, *([s[i] for s in found] for i in range(3)), _longs([s[3] for s in found])]

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, h long, digest binary, n int, sim long, bands array<long>"
    return map_texts(rows, ["key", "h", "body"], work, schema)


def _sets(rows: DataFrame) -> DataFrame:
    """``id`` and ``shingles``, once for each ``id`` whose ``digest`` the text has."""

    def work(batches: Iterator[list[list]]) -> Iterator[list]:
        for ids, digests, texts in batches:
            found = [shingles(t) for t in texts]
            own = [xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(found, digests, strict=True)]
            kept = [s.view(np.int64) for s, mine in zip(found, own, strict=True) if mine]
            yield [[i for i, mine in zip(ids, own, strict=True) if mine], _longs(kept)]

    found = map_texts(rows, ["id", "digest", "body"], work, "id long, shingles array<long>")
    return found.groupBy("id").agg(F.first("shingles").alias("shingles"))


def _near(n: Column, m: Column, sim: Column, other: Column) -> Column:
    """What texts at the limit have: sizes no further apart, prints within the radius."""
    return (OF * F.least(n, m) >= SHARED * F.greatest(n, m)) & (F.bit_count(sim.bitwiseXOR(other)) <= RADIUS)


def _compared(pairs: DataFrame, rows: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` that are alike."""
    pairs = cut(pairs.distinct())
    used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = prints.join(used, "id").select("id", "digest", "key")
    sets = cut(_sets(rows.select("key", "body").join(wanted.hint("shuffle_hash"), "key")))
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(first, "a").join(second, "b")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.filter(OF * common >= SHARED * (F.size("x") + F.size("y") - common)).select("a", "b"))


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """Pairs ``a`` > ``b`` whose SimHash prints are the same or, by the tables of distances, nearly so.

    Texts with one print stand behind the smallest id of them.
    """
    first = cut(prints.groupBy("sim").agg(F.min("id").alias("id")))
    same = prints.select("id", "sim").join(first.select("sim", F.col("id").alias("b")), "sim").filter("id != b")
    near = simhash_dedup.near_links(first.select("id", F.col("sim").alias("fp")))
    met = same.select(F.col("id").alias("a"), "b").unionByName(near.select("a", "b"))
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def near_links(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that connect all of ``prints`` that are alike and have near prints or share a band.

    Under each band key, all are compared with the smallest id there; only those unlike it are
    compared with the rest, so that a group of copies costs one comparison for each.
    """
    keyed = prints.select("id", "n", "sim", F.explode("bands").alias("band")).repartition("band")
    leaders = keyed.groupBy("band").agg(F.min(F.struct("id", "n", "sim")).alias("leader"), F.count("*").alias("k"))
    members = cut(keyed.join(leaders.filter("k > 1").drop("k").hint("shuffle_hash"), "band"))
    members = members.select("band", "id", "n", "sim", F.col("leader.id").alias("leader"), "leader.n", "leader.sim").toDF(
        "band", "id", "n", "sim", "leader", "leader_n", "leader_sim"
    )
    followers = members.filter("id != leader")
    led = followers.filter(_near(*map(F.col, ("n", "leader_n", "sim", "leader_sim"))))
    with_leader = led.select(F.col("id").alias("a"), F.col("leader").alias("b")).unionByName(simhash_pairs(prints))
    with_leader = _compared(with_leader, rows, prints)
    met = with_leader.select(F.col("a").alias("id"), F.col("b").alias("leader"))
    rest = followers.join(met, ["id", "leader"], "left_anti")
    rest = rest.select("band", F.col("id").alias("other"), F.col("n").alias("m"), F.col("sim").alias("print"))
    crossed = followers.join(rest, "band").filter(
        (F.col("id") != F.col("other")) & _near(*map(F.col, ("n", "m", "sim", "print")))
    )
    pairs = crossed.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return with_leader.unionByName(_compared(pairs, rows, prints))


def one_of_each_near(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest key, of each group of near copies.

    Rows that repeat a key are documents of their own unless their texts are the same; rows
    without a key all stay. Texts without words are copies of each other.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("body"))
    rows = rows.filter("key IS NOT NULL")
    found = cut(sketches(rows))
    one = [F.first(c).alias(c) for c in ("n", "sim", "bands")]
    prints = found.groupBy("digest").agg(F.min("key").alias("key"), *one)
    prints = cut(prints.withColumn("id", F.monotonically_increasing_id()))
    groups = components(near_links(rows, prints), "a", "b")
    groups = prints.join(groups, "id", "left").select("digest", "key", F.coalesce("component", "id").alias("component"))
    kept = groups.groupBy("component").agg(F.min("key").alias("kept"))
    kept = groups.join(kept, "component").select("digest", "kept")
    spare = found.join(kept, "digest").filter("key != kept").select("key", "h").distinct()
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    k, t = (F.col(f"c{docs.columns.index(c)}") for c in (key, text))
    return named.join(cut(spare), (k == F.col("key")) & (F.xxhash64(t) == F.col("h")), "left_anti").toDF(*docs.columns)
