"""Quality scores by nearest labelled neighbours in a latent-semantic space.

Texts become vectors of byte trigram weights (hashed), reduced by a truncated singular
value decomposition of labelled texts. The labelled vectors go to every executor; each
document is compared with all of them by exact blocked cosine products, and the labels of
the nearest ones are weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BINS = 4096
TERMS = BINS + 2
#: Weight of the two terms on repeated words against one trigram.
STRUCTURE = np.float32(4)
RANK = 64
#: Labelled rows that the model is fitted on and votes with, at most; the smallest digests of their keys.
MAX_LABELLED = 4096
NEIGHBOURS = 15
SHARPNESS = 4
CHUNK = 1 << 20
BLOCK = 256
SEED = 42
HELD_OUT = 2
THRESHOLD = 0.7


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == HELD_OUT


def counts(raw: bytes | None) -> np.ndarray:
    """How often each hashed byte trigram occurs in a text, all of it; and as two terms more,
    how often a word follows itself and how often a word has been there before."""
    data = np.frombuffer(raw or b"", dtype=np.uint8)
    total = np.zeros(TERMS, dtype=np.float32)
    words = (raw or b"").split()
    total[BINS] = sum(map(eq, words, words[1:]))
    total[BINS + 1] = len(words) - len(set(words))
    for at in range(0, max(0, len(data) - 2), CHUNK):
        part = data[at : at + CHUNK + 2].astype(np.uint32)
        code = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        code *= np.uint32(2654435761)
        total[:BINS] += np.bincount(code >> np.uint32(20), minlength=BINS)
    return total


def damped(tallies: np.ndarray) -> np.ndarray:
    rows = np.sqrt(tallies)
    rows[:, BINS:] *= STRUCTURE
    return rows


def unit(rows: np.ndarray) -> np.ndarray:
    sizes = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, sizes, out=np.zeros_like(rows), where=sizes > 0)


@dataclass
class Model:
    weights: np.ndarray  # of the terms
    basis: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled rows x rank, of length one
    labels: np.ndarray
    prior: float

    def project(self, tallies: np.ndarray) -> np.ndarray:
        return unit(unit(damped(tallies) * self.weights) @ self.basis)

    def score(self, tallies: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity; the prior where nothing is alike."""
        if not len(self.labels):
            return np.full(len(tallies), self.prior)
        close = self.project(tallies) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        # equal similarities are all one: a tie at the border falls by the order of the labelled rows
        nearest = np.argpartition(-close, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(close, nearest, axis=1), 0, None).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[nearest]).sum(axis=1)
        return np.where(total > 1e-12, np.clip(votes / np.maximum(total, 1e-12), 0, 1), self.prior)


def fit(tallies: np.ndarray, labels: np.ndarray) -> Model:
    """The latent space of labelled texts: a randomised decomposition with a fixed seed."""
    n = len(labels)
    if not n:
        empty = np.zeros((0, RANK), dtype=np.float32)
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, RANK), np.float32), empty, np.zeros(0), 0.5)
    weights = np.log((1 + n) / (1 + (tallies > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    rows = unit(damped(tallies) * weights)
    draw = np.random.default_rng(SEED).standard_normal((TERMS, RANK + 16)).astype(np.float32)
    basis = np.linalg.qr(rows.T @ (rows @ draw))[0]
    for _ in range(4):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    small = rows @ basis
    turn = np.linalg.svd(small, full_matrices=False)[2]
    basis = np.ascontiguousarray((basis @ turn.T)[:, :RANK], dtype=np.float32)
    model = Model(weights, basis, np.zeros((0, RANK), np.float32), labels, float(labels.mean()))
    model.vectors = model.project(tallies)
    return model


def fit_labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int) -> Model:
    """A model of at most ``limit`` labelled rows that are not held out.

    The rows with the smallest digests of their keys are taken, so that the choice depends
    on nothing but the keys; only their trigram counts come to the driver.
    """
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    chosen = (
        usable.groupBy(F.col(key).alias("key"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(limit)
    )
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, found, texts in batches:
            yield [keys, found, [counts(t).tobytes() for t in texts]]

    kind = docs.schema[key].dataType.simpleString()
    tallies = map_texts(rows, ["key", "label", "text"], work, f"key {kind}, label int, tally binary")
    # a key that documents repeat counts once, so that the bound holds
    found = tallies.groupBy("key", "label").agg(F.min("tally").alias("tally")).orderBy("key").toLocalIterator()
    labelled, vectors = [], np.zeros((limit, TERMS), dtype=np.float32)
    for row in found:
        vectors[len(labelled)] = np.frombuffer(row["tally"], dtype=np.float32)
        labelled.append(row["label"])
    return fit(vectors[: len(labelled)], np.array(labelled, dtype=np.float64))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    limit: int = MAX_LABELLED,
) -> DataFrame:
    """``key``, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every row.

    Labels of rows whose CRC-32 of the key, mod 4, is ``HELD_OUT`` are never learnt from. A
    null or empty text is like nothing and scores the share of label 1, as does every text
    without any labels (then one half). Rows without a key are scored and not held out.
    Repeated keys give a row each; of several labels of a key the largest counts; an empty
    table gives an empty one; only key and text are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_labelled(docs, labels, key, text, label, limit))

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, out, texts in batches:
            for at in range(0, len(keys), BLOCK):
                tallies = np.stack([counts(t) for t in texts[at : at + BLOCK]])
                scores = model.value.score(tallies)
                yield [
                    keys[at : at + BLOCK],
                    out[at : at + BLOCK],
                    scores.tolist(),
                    (scores >= THRESHOLD).astype(int).tolist(),
                ]

    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(held_out(F.col(key)), F.lit(False)).alias("out"), F.col(text).alias("text")
    )
    kind = docs.schema[key].dataType.simpleString()
    return map_texts(rows, ["key", "out", "text"], work, f"`{key}` {kind}, held_out boolean, score double, predicted int")
