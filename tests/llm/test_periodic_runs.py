"""Runs against a comparison of every text with itself at every distance."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import PROSE
from veilspan.llm import periodic_runs as pr
from veilspan.llm.queries import op11_periodic_runs, with_repeats


def slow_runs(words, min_length=6, min_exponent=4):
    best = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(min_length, min_exponent * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def slow_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def found(words, *limits):
    return list(zip(*(x.tolist() for x in pr.find_runs(np.array(words, dtype=np.int64), *limits)), strict=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 7)), max_size=8))
def test_any_words(parts):
    words = [w for unit, times in parts for w in unit * times]
    for limits in ((6, 4), (2, 2), (5, 3), (1, 5)):
        assert found(words, *limits) == slow_runs(words, *limits)


def test_many_texts_at_once(monkeypatch):
    """Texts that equal each other, whole or in part, and batches of any size do not mix."""
    draw = random.Random(4)
    texts = [" ".join(draw.choice("ab") for _ in range(draw.randrange(40))).encode() for _ in range(60)]
    texts += texts[:20] + [b"a " * 50, None, b"", b"a " * 50]
    plain = [(t or b"").split() for t in texts]
    for size, step in ((1 << 17, 1 << 20), (50, 7), (1, 1)):
        monkeypatch.setattr(pr, "BATCH_WORDS", size)
        monkeypatch.setattr(pr, "STEP", step)
        rows = [r for part in pr._batches(texts) for r in pr._work(part, 6, 4)]
        assert [r[0] for r in rows] == [len(w) for w in plain]
        assert [[(x["start"], x["length"], x["period"]) for x in r[1]] for r in rows] == [slow_runs(w) for w in plain]
        assert [r[2].split() for r in rows] == [slow_collapsed(w, slow_runs(w)) for w in plain]


def test_long_texts():
    assert found([7] * 100_000) == [(0, 100_000, 1)]
    long = list(range(1000)) * 30
    assert found([5000, *long, 5001]) == [(1, 30_000, 1000)]
    words = np.random.default_rng(1).integers(0, 3, 2000).tolist()
    assert found(words) == slow_runs(words)


def slow_query(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    rest = " ".join(slow_collapsed(words, runs))
    return (doc_id, len(runs), start, length, period, 1000 * length // period if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())


def test_query_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {tuple(r) for r in op11_periodic_runs(spark, sf_dir).collect()}
    short = [r for r in docs if len(r.text or "") < 60_000]
    assert len(got) == len(docs) and len(short) > 150
    assert {slow_query(r.doc_id, r.text) for r in short} <= got
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(odd_docs, no_docs):
    rows = pr.periodic_runs(odd_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, len(r.runs)) for r in rows) == [
        (False, 0, 0, 0), (False, 1, 0, 0), (False, 2, 0, 0), (False, 3, 60_000 + len(PROSE.split()), 0),
        (False, 4, len(PROSE.split()), 0), (False, 4, len(PROSE.split()), 0), (False, 7, 4, 0),
        (True, 0, 5 + len(PROSE.split()), 0),
    ]
    assert all(r.collapsed is not None for r in rows)
    assert pr.periodic_runs(no_docs).count() == 0 and with_repeats(no_docs).count() == 0
    assert with_repeats(odd_docs).count() == 8


def test_real_output(docs_of):
    row = pr.periodic_runs(docs_of(f"{PROSE} " + "buy it now " * 9 + PROSE)).first()
    n = len(PROSE.split())
    assert [tuple(r) for r in row.runs] == [(n, 27, 3)]
    assert row.collapsed == f"{PROSE} buy it now {PROSE}"
    with pytest.raises(ValueError):
        pr.periodic_runs(docs_of(""), min_exponent=1)
