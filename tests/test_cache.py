"""The cache of a request log against a replay, one request after the other."""

import random
from collections import OrderedDict

import pytest

from veilspan.operators import cache


def replay(log, capacity, ttl):
    held, hits = OrderedDict(), {}
    for n, key, at in sorted(log, key=lambda r: r[0]):
        hits[n] = False
        if key is None or at is None:
            continue
        if key in held:
            if at - held[key] > ttl:
                del held[key]
            else:
                held.move_to_end(key)
                hits[n] = True
                continue
        elif len(held) >= capacity:
            held.popitem(last=False)
        held[key] = at
    return hits


@pytest.mark.parametrize(("seed", "capacity", "ttl", "width", "fan"), [(1, 4, 30, 8, 2), (2, 1, 5, 3, 3), (3, 50, 100, 64, 2), (4, 6, 10**6, 16, 4)])
def test_against_replay(spark, monkeypatch, seed, capacity, ttl, width, fan):
    """Many short stretches, keys that stand for a third of all requests, gaps in the numbers."""
    monkeypatch.setattr(cache, "FAN", fan)
    draw, log, at = random.Random(seed), [], 0.0
    for n in sorted(draw.sample(range(900), 400)):
        at += draw.choice([0, 1, 1, 2, 9]) if n % 100 else 300
        key = "hot" if draw.random() < 0.33 else f"k{int(draw.expovariate(0.3))}"
        log.append((n, key if draw.random() > 0.02 else None, at if draw.random() > 0.02 else None))
    df = spark.createDataFrame(log, "n long, key string, at double")
    got = {r.n: r.hit for r in cache.cache_hits(df, capacity=capacity, ttl_seconds=ttl, width=width).collect()}
    assert got == replay(log, capacity, ttl)
    assert 10 < sum(got.values())


def test_empty_log(spark):
    df = spark.createDataFrame([], "n long, key string, at double")
    assert cache.cache_hits(df).count() == 0
