"""Quality votes: held-out accuracy, what is learnt from, and a plain nearest-neighbour count."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from veilspan.llm import quality_knn as qk


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = qk.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in tested) >= 0.95 * len(tested)


def test_learns_from_nothing_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, qk.quality_scores(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_votes_as_counted_plainly():
    draw = np.random.default_rng(3)
    tallies = draw.integers(0, 6, (60, qk.TERMS)).astype(np.float32)
    labels = draw.integers(0, 2, 60).astype(float)
    model = qk.fit(tallies, labels)
    asked = model.project(tallies[:9] + 1)
    for row, score in zip(asked, model.score(tallies[:9] + 1), strict=True):
        close = sorted(((float(row @ v), y) for v, y in zip(model.vectors, labels, strict=True)), reverse=True)
        nearest = [(max(s, 0) ** qk.SHARPNESS, y) for s, y in close[: qk.NEIGHBOURS]]
        assert abs(score - sum(w * y for w, y in nearest) / sum(w for w, _ in nearest)) < 1e-4


def test_long_texts_are_counted_whole(monkeypatch):
    raw = b"abcde fgh " * 5000
    whole = qk.counts(raw)
    monkeypatch.setattr(qk, "CHUNK", 777)
    assert np.array_equal(qk.counts(raw), whole) and whole[: qk.BINS].sum() == len(raw) - 2


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = qk.quality_scores(odd_docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 8
    assert got.filter("doc_id IS NULL AND NOT held_out").count() == 1
    none = labels.filter(F.lit(False))
    assert {r.score for r in qk.quality_scores(odd_docs, none).collect()} == {0.5}
    assert qk.quality_scores(no_docs, labels).count() == 0
