"""Benchmark decontamination: which test items lie inside which documents.

Items are divided by size. For each size class, an item's MinHash sketch holds so many of
its smallest shingle hashes that a document without any of them cannot hold enough of the
item's shingles. Documents long enough for a class are searched for sketch hashes, and
candidates are verified by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_texts

WIDTH = 5
LEAST = 0.8
SEED = 42
#: Items searched for at once; more items take more passes over the documents.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 * 1024 * 1024
SIZE_FACTOR = 2.0

_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


def shingles_of(words: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, SEED) for w in words), dtype=np.uint64, count=len(words))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rolling hashes of all runs of ``width`` words, mixed so that small ones are as good as drawn."""
    if len(hashes) < width:
        return hashes[:0]
    rolling = hashes[: len(hashes) - width + 1].copy()
    for i in range(1, width):
        rolling = rolling * _BASE + hashes[i : len(hashes) - width + 1 + i]
    rolling ^= rolling >> np.uint64(31)
    rolling *= np.uint64(0xBF58476D1CE4E5B9)
    return rolling ^ (rolling >> np.uint64(29))


class SizeClass:
    """Items of like size and one shingle width, with their sketches in one sorted array."""

    def __init__(self, width: int, least: float, items: list[tuple[object, list[bytes]]]) -> None:
        self.width = width
        self.items = [(key, frozenset(shingles_of(words, width))) for key, words in items]
        self.smallest = min(len(s) for _, s in self.items)
        self.needed = [int(np.ceil(least * len(s) - 1e-9)) for _, s in self.items]
        rows = []
        for number, ((_, words), (_, own)) in enumerate(zip(items, self.items, strict=True)):
            ranked = np.unique(shingle_hashes(word_hashes(words), width))
            # a document may lack size - needed shingles: one more than that must hit
            rows += [(h, number) for h in ranked[: len(own) - self.needed[number] + 1].tolist()]
        rows.sort()
        self.hashes = np.array([h for h, _ in rows], dtype=np.uint64)
        self.numbers = np.array([n for _, n in rows], dtype=np.int64)

    def search(self, words: list[bytes], found: np.ndarray, least: float) -> list[tuple[object, int, int]]:
        """Items of which ``least`` of the shingles are in a document: key, shared and all shingles."""
        if len(found) < least * self.smallest or not len(found):
            return []
        place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hits = np.unique(found[self.hashes[place] == found])
        if not len(hits):
            return []
        low = np.searchsorted(self.hashes, hits, side="left")
        high = np.searchsorted(self.hashes, hits, side="right")
        numbers = sorted({int(n) for a, b in zip(low, high, strict=True) for n in self.numbers[a:b]})
        own = set(shingles_of(words, self.width))
        results = []
        for n in numbers:
            key, wanted = self.items[n]
            shared = len(wanted & own)
            if shared >= self.needed[n]:
                results.append((key, shared, len(wanted)))
        return results


def size_classes(items: list[tuple[object, bytes]], width: int = WIDTH, least: float = LEAST) -> list[SizeClass]:
    """Items by shingle width (shorter items are one shingle of all their words) and size."""
    classes: dict[tuple[int, int], list] = {}
    for key, raw in items:
        words = words_of(raw)
        if words:
            own = min(width, len(words))
            size = len(words) - own + 1
            classes.setdefault((own, int(np.log(size) / np.log(SIZE_FACTOR))), []).append((key, words))
    return [SizeClass(own, least, found) for (own, _), found in sorted(classes.items())]


def search(raw: bytes | None, classes: list[SizeClass], least: float) -> list[tuple[object, int, int]]:
    words = words_of(raw)
    hashes = word_hashes(words)
    rolled = {w: shingle_hashes(hashes, w) for w in {c.width for c in classes}}
    return [hit for c in classes for hit in c.search(words, rolled[c.width], least)]


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of bounded size, in no order; one block is in memory at a time."""
    block, size = [], 0
    for row in items.select(F.col(key), F.col(text).cast("binary")).toLocalIterator():
        raw = bytes(row[1] or b"")
        if block and (len(block) >= BLOCK_ITEMS or size + len(raw) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row[0], raw))
        size += len(raw)
    yield block


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    least: float = LEAST,
) -> DataFrame:
    """One row per document and item of whose distinct shingles the document holds ``least`` or more.

    Gives ``key``, ``item_key``, n_shared, n_shingles and containment. Words are lower-cased
    (A-Z) runs without white space, shingles ``width`` words; an item of fewer words is one
    shingle of all of them. Null and empty texts and items match nothing. Repeated keys give a
    row each; ties do not arise; no items or no documents give an empty table; other columns
    are not read.

    The items go to the executors in blocks of at most ``BLOCK_ITEMS`` items and
    ``BLOCK_BYTES`` of text, a pass over the documents for each; nothing is shuffled and a
    match is missed by none of the two steps.
    """
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, n_shared long, n_shingles long, containment double"
    result = None
    for block in item_blocks(items, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches: Iterator[list[list]], shared=shared) -> Iterator[list[list]]:
            classes = size_classes(shared.value, width, least)
            for keys, texts in batches:
                rows = [
                    (k, item, n, of, n / of)
                    for k, raw in zip(keys, texts, strict=True)
                    for item, n, of in search(raw, classes, least)
                ]
                yield list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in range(5)]

        part = map_texts(docs, [key, text], work, schema)
        result = part if result is None else result.unionByName(part)
    return result


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; a pass for each block of items."""
    for block in item_blocks(items, item_text, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def wanted(batches: Iterator[list], shared=shared) -> Iterator[list[bool]]:
            classes = size_classes(shared.value)
            for texts in batches:
                yield [not search(t, classes, LEAST) for t in texts]

        docs = keep_rows(docs, text, wanted)
    return docs
