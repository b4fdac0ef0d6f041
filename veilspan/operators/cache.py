"""Which requests of a log a response cache of limited size and age would have answered."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prompts import CACHE_TTL_SECONDS
from .steps import computed

CAPACITY = 1000
#: Requests that are replayed in one task, from what the cache holds before them.
REQUESTS = 1 << 16
#: Stretches of the log that are merged into the next longer one.
FAN = 32


def _latest(uses: DataFrame, capacity: int) -> DataFrame:
    """Of each stretch ``b`` the ``capacity`` keys used last, with their last use ``n``."""
    last = uses.groupBy("b", "key").agg(F.max("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n")))
    return last.withColumn("rank", rank).filter(F.col("rank") <= capacity).drop("rank")


def _held_before(latest: DataFrame, stretches: DataFrame, top: int, capacity: int) -> DataFrame:
    """What the cache holds at the start of each of ``stretches``: b, key, n.

    ``latest`` has the keys used last in each stretch 0 to ``top``. A stretch is preceded by its
    earlier siblings under the same parent and by what the parent is preceded by: lists of at
    most ``capacity`` keys that merge in any grouping.
    """
    end = F.expr(f"(b div {FAN}) * {FAN} + {FAN - 1}")
    later = latest.filter(F.col("b") < end).withColumn("b", F.explode(F.sequence(F.col("b") + 1, end)))
    if top >= FAN:
        up = F.expr(f"b div {FAN}").alias("b")
        parents = computed(_latest(latest.select(up, "key", "n"), capacity))
        above = _held_before(parents, stretches.select(up).distinct(), top // FAN, capacity)
        first = F.col("b") * FAN
        later = later.unionByName(above.withColumn("b", F.explode(F.sequence(first, first + FAN - 1))))
    return _latest(later.join(stretches, "b", "left_semi"), capacity)


def _replay(capacity: int):
    """Requests of a stretch, marked where their key is among the ``capacity`` used last."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        held: OrderedDict[str, None] = OrderedDict()
        resident = []
        for key, asked in zip(rows["key"], rows["asked"], strict=True):
            known = key in held
            if known:
                held.move_to_end(key)
            elif capacity:
                if len(held) >= capacity:
                    held.popitem(last=False)
                held[key] = None
            if asked:
                resident.append(known)
        own = rows[rows["asked"]]
        return pd.DataFrame({"n": own["n"], "resident": resident})

    return run


def resident_requests(requests: DataFrame, capacity: int = CAPACITY, width: int = REQUESTS) -> DataFrame:
    """``n`` and ``resident``: whether fewer than ``capacity`` other keys came since the key's last request.

    ``requests`` has ``n``, whole numbers from 0, each once, in the order of the requests, and
    ``key``. The log is replayed in stretches of ``width`` numbers, all at once, each from the
    list of keys that the cache holds before it.
    """
    rows = computed(requests.select("n", "key", F.expr(f"n div {width}").alias("b")))
    top = rows.agg(F.max("b")).first()[0] or 0
    latest = computed(_latest(rows, capacity))
    held = _held_before(latest, rows.select("b").distinct(), top, capacity)
    marked = rows.withColumn("asked", F.lit(True)).unionByName(held.withColumn("asked", F.lit(False)))
    return marked.groupBy("b").applyInPandas(_replay(capacity), "n long, resident boolean")


def _next_of(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``name``: the first ``value`` that is not null in a later row of the same key, by (slot, at, kind, n).

    Rows are sorted within slots of time; from slot to slot, one row for each key and slot is
    looked through.
    """
    back = [F.desc("at"), F.desc("kind"), F.desc("n")]
    inside = Window.partitionBy("key", "slot").orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)
    some = rows.filter(F.col(value).isNotNull())
    firsts = some.groupBy("key", "slot").agg(F.min(F.struct("at", "kind", "n", value)).alias("f"))
    slots = rows.select("key", "slot").distinct().join(firsts, ["key", "slot"], "left")
    across = Window.partitionBy("key").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    later = slots.select("key", "slot", F.last(f"f.{value}", ignorenulls=True).over(across).alias("__later"))
    own = rows.withColumn("__own", F.last(value, ignorenulls=True).over(inside))
    return own.join(later, ["key", "slot"]).withColumn(name, F.coalesce("__own", "__later")).drop("__own", "__later")


def cache_hits(
    log: DataFrame,
    order: str = "n",
    key: str = "key",
    at: str = "at",
    capacity: int = CAPACITY,
    ttl_seconds: int = CACHE_TTL_SECONDS,
    width: int = REQUESTS,
) -> DataFrame:
    """``order`` and ``hit`` of every request, as a cache that drops what was used longest ago gives them.

    ``order`` holds whole numbers from 0, each once, in the order of ``at`` (seconds, or a
    timestamp). A request is a hit if its key is held, that is, fewer than ``capacity`` other keys
    were asked for since, and if its answer is at most ``ttl_seconds`` old. An answer is as old as
    the last request that was no hit. Requests with a null key or time are never hits and leave
    the cache as it is. No task holds more than ``width`` requests and ``capacity`` keys.
    """
    names = [F.col(order).cast("long").alias("n"), F.col(key).cast("string").alias("key")]
    requests = computed(log.select(*names, F.col(at).cast("double").alias("at")))
    known = requests.filter("key IS NOT NULL AND at IS NOT NULL")
    marked = computed(known.join(resident_requests(known, capacity, width), "n"))

    # The request that finds the answer of this one too old: the first more than ttl_seconds later.
    slot = F.floor(F.col("at") / F.lit(float(max(ttl_seconds, 1)))).cast("long").alias("slot")
    put = F.when(~F.col("resident"), F.col("n"))
    own = [F.lit(0).alias("kind"), F.col("n").alias("request"), put.alias("put")]
    events = marked.select("key", "n", "at", slot, *own)
    none = F.lit(None).cast("long")
    due = events.select("key", "n", (F.col("at") + F.lit(float(ttl_seconds))).alias("at"))
    due = due.select("key", "n", "at", slot, F.lit(1).alias("kind"), none.alias("request"), none.alias("put"))
    stale = _next_of(events.unionByName(due), "request", "stale").filter("kind = 1").select("n", "stale")
    renewed = _next_of(events, "put", "renewed").select("n", "renewed")
    jumps = computed(
        stale.filter("stale IS NOT NULL").join(renewed, "n")
        .filter("renewed IS NULL OR renewed > stale").select("n", F.col("stale").alias("to"))
    )
    # Answers are renewed along these jumps; each round doubles their length.
    puts = computed(marked.filter("NOT resident").select("n"))
    before = puts.count()
    while True:
        reached = jumps.join(puts, "n").select(F.col("to").alias("n"))
        puts = computed(puts.unionByName(reached).distinct())
        now = puts.count()
        if now == before:
            break
        before = now
        twice = jumps.withColumnsRenamed({"n": "from", "to": "n"}).join(jumps, "n")
        jumps = computed(twice.select(F.col("from").alias("n"), "to"))
    missed = puts.withColumn("put", F.lit(True))
    return requests.join(missed, "n", "left").select(
        F.col("n").alias(order),
        (F.col("put").isNull() & F.col("key").isNotNull() & F.col("at").isNotNull()).alias("hit"),
    )
