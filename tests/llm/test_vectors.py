"""Hard negatives and exact search against plain loops, and their parts."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspan.llm import hard_negatives as hn
from veilspan.llm import vector_files as vf
from veilspan.llm import vectors

SCHEMA = "vec_id long, embedding array<double>, label int, id string, score int, rank string, v int, h1 int, asked int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4) for r in rows], SCHEMA)


def plain(rows):
    """Distinct rows that take part, with whole numbers of one length."""
    found = {
        (i, tuple(math.floor(256 * x) for x in v), label)
        for i, v, label in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)
    }
    width = max((len(v) for _, v, _ in found), default=0)
    return sorted(((i, v + (0,) * (width - len(v)), label) for i, v, label in found), key=str)


def dot(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))


def slow_top_k(rows, every, k):
    rows = sorted({(i, v) for i, v, _ in plain(rows)})
    out = []
    for q in rows:
        if q[0] % every == 0:
            best = sorted((-dot(q[1], c[1]), c[0]) for c in rows if c != q)[:k]
            out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def slow_negatives(rows, every, n_pos=5, n_neg=10):
    rows = [r for r in plain(rows) if r[2] is not None]
    out = []
    for a in rows:
        if a[0] % every:
            continue
        pos = sorted((-dot(a[1], c[1]), c[0]) for c in rows if c != a and c[2] == a[2])[:n_pos]
        neg = sorted((-dot(a[1], c[1]), c[0]) for c in rows if c[2] != a[2])
        for s, p in pos:
            inside = [(n, i) for n, i in neg if 30 * -s <= 100 * -n <= 90 * -s][:n_neg]
            out += [(a[0], p, k + 1, i, -s, -n) for k, (n, i) in enumerate(inside)]
    return sorted(out)


def some_rows(n, seed, labels=3, hot=0, width=7):
    draw = random.Random(seed)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(width)], draw.randrange(labels)) for i in range(n)]
    for i in draw.sample(range(n), hot):
        rows[i] = (i, [0.5, -0.25] + [0.125] * (width - 2), rows[i][2])
    return rows


ODD = [
    (None, [1.0] * 7, 1), (900, None, 1), (900, [1.0, None, 1.0], 1), (1000, [math.nan] * 7, 0), (1000, [math.inf] + [0.0] * 6, 0),
    (1000, [1e308] * 7, 0), (1100, [], 1), (1200, [0.5, 0.5], 1), (1201, [0.9] * 9, None), (1300, [0.1] * 7, 1), (1300, [0.1] * 7, 1),
    (1300, [0.2] * 7, 1), (1300, [0.2] * 7, 2), (-50, [0.3] * 7, 0),
]


@pytest.fixture
def rows(request):
    return {
        "plain": some_rows(230, 1),
        "hot": some_rows(230, 2, hot=90),
        "odd": some_rows(120, 3) + ODD,
        "ties": [(i, [float(i % 3), 1.0], i % 2) for i in range(90)],
        "huge": [(i, [x * 1e16 for x in v], label) for i, v, label in some_rows(60, 4)],
        "few": some_rows(3, 5),
    }[request.param]


def small_tiles(monkeypatch):
    for module, name, value in (
        (vectors, "BLOCK", 3), (vectors, "STRIPE", 40), (vectors, "LEAST_STRIPE", 20), (hn, "TILE", (2, 16)), (hn, "LEAF", 2),
        (vf, "TILE", (2, 8)), (vf, "CELLS", 8),
    ):
        monkeypatch.setattr(module, name, value)


@pytest.mark.parametrize(
    ("rows", "small"),
    [("odd", False), ("hot", True), ("odd", True), ("ties", True), ("huge", True), ("few", True)],
    indirect=["rows"],
)
def test_against_loops(spark, rows, small, monkeypatch):
    """With tiles, blocks and cells of the usual and of a very small size."""
    if small:
        small_tiles(monkeypatch)
    got = vf.exact_top_k(table(spark, rows), "vec_id % 50 = 0", k=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == slow_top_k(rows, 50, 4)
    got = hn.hard_negatives(table(spark, rows), "vec_id % 30 = 0")
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == columns and sorted(tuple(r) for r in got.collect()) == slow_negatives(rows, 30)


def test_nothing(spark):
    assert vf.exact_top_k(table(spark, []), "vec_id % 50 = 0").count() == 0
    assert hn.hard_negatives(table(spark, []), "vec_id % 50 = 0").count() == 0
    assert vf.exact_top_k(table(spark, [(0, [], 0), (1, [], 1)]), "vec_id = 0").count() == 1
    assert hn.hard_negatives(table(spark, some_rows(9, 1)), "vec_id = 99").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.sampled_from([9, 2**20, 2**40]), st.integers(0, 99))
def test_strassen(n, k, m, size, seed):
    draw = np.random.default_rng(seed)
    a, b = draw.integers(-size, size, (n, k)), draw.integers(-size, size, (m, k))
    real = np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)
    old, hn.LEAF = hn.LEAF, 3
    try:
        assert (hn.products(a, b) == real).all()
    finally:
        hn.LEAF = old


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 999), st.sampled_from([1, 3, 300, 2**40, 2**60]))
def test_cells_hold_their_vectors(seed, size):
    draw = np.random.default_rng(seed)
    m = draw.integers(-size, size + 1, (200, 5))
    cells = vf.Cells(m[: draw.integers(0, 50)], m.min(axis=0), m.max(axis=0))
    low, high = cells.borders(cells.code(m))
    assert (low <= m).all() and (m <= high).all()
    least, most = vf.bounds(m[:9], low, high)
    real = m[:9].astype(object) @ m.astype(object).T
    real = [max(-(2**63), min(2**63 - 1, x)) for x in real.ravel()]
    assert all(a <= x <= b for a, x, b in zip(least.ravel().tolist(), real, most.ravel().tolist(), strict=True))


def test_matrix():
    lists = pa.chunked_array([pa.array([[1, 2], [], [3]]), pa.array([[4, 5, 6]])])
    assert vectors.matrix(lists).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0], [4, 5, 6]]
    assert vectors.matrix(pa.array([[1], [2], [3]]).slice(1, 2), 2).tolist() == [[2, 0], [3, 0]]
    assert vectors.matrix(pa.chunked_array([], type=pa.list_(pa.int64())), 3).shape == (0, 3)
