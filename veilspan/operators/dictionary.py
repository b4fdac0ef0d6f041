"""Spans of very many literal values: names, account numbers, anything that stands in a table."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import SPAN_TYPE, span_struct

#: Values, and bytes of them, that one file holds; a larger dictionary has several.
MAX_VALUES = 500_000
MAX_BYTES = 32 << 20
FOUND = "array<struct<start:int,end:int,value:string,entity_type:string>>"
#: Characters that are looked through at a time, unless one text has more.
STRETCH = 1 << 18
#: Stands between texts; no character.
GAP = 0xFFFFFFFF
#: The odd number whose powers hashes are made of, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PACKED = "hashes binary, sizes binary, ends binary, value binary, kinds array<array<string>>"


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def _longest(found: list[tuple[int, int, str, str]]) -> list[dict]:
    """In order of start, without those inside a longer one."""
    kept, end = [], -1
    for a, b, value, kind in sorted(found, key=lambda f: (f[0], -f[1], f[3])):
        if b > end or (kept and (a, b) == (kept[-1]["start"], kept[-1]["end"])):
            kept.append({"start": a, "end": b, "value": value, "entity_type": kind})
            end = max(end, b)
    return kept


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, dtype=np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


class Stretches:
    """Code points of texts with a gap after each, and hashes of any stretch of them."""

    def __init__(self, texts: list[str]) -> None:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.codes = np.full(int(sizes.sum()) + len(texts), GAP, dtype=np.uint32)
        inside = np.ones(len(self.codes), dtype=bool)
        inside[self.starts + sizes] = False
        self.codes[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        sums = np.cumsum(self.codes * _powers(BASE, len(self.codes)), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), sums])
        self.back = _powers(INVERSE, len(self.codes))

    def hashes(self, at: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        """Of ``sizes`` characters from ``at`` on; the same characters have the same one everywhere."""
        return (self.sums[at + sizes] - self.sums[at]) * self.back[at]

    def inner(self) -> np.ndarray:
        """Whether a word goes on from the place before; one more than there are places."""
        known, which = np.unique(self.codes, return_inverse=True)
        word = np.array([c != GAP and _is_word(chr(c)) for c in known.tolist()], dtype=bool)[which]
        return np.concatenate([[False], word[1:] & word[:-1], [False]])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a batch of values: their hashes, lengths, where their bytes end, these, and their types."""
    schema = pa.schema([*[(c, pa.binary()) for c in ("hashes", "sizes", "ends", "value")], ("kinds", pa.list_(pa.list_(pa.string())))])
    for batch in batches:
        if batch.num_rows:
            values = batch.column(0).to_pylist()
            own, raw = Stretches(values), [v.encode() for v in values]
            sizes = np.array([len(v) for v in values], dtype=np.int64)
            ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
            row = own.hashes(own.starts, sizes).tobytes(), sizes.tobytes(), ends.tobytes(), b"".join(raw), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


def _file(values: DataFrame, folder: str) -> dict:
    """Write values (v, t) as one file, by length and hash; gives its name, number of values, lengths and types.

    Only numbers of the values are held on the driver, their texts pass it a batch at a time.
    """
    name, kinds = f"dictionary-{uuid.uuid4().hex}.bin", {}
    hashes, sizes, ends, numbers, n_bytes = [], [], [np.zeros(1, dtype=np.int64)], [], 0
    with open(os.path.join(folder, name), "wb") as out:
        for r in values.mapInArrow(_packed, PACKED).toLocalIterator():
            hashes.append(np.frombuffer(r.hashes, dtype=np.uint64))
            sizes.append(np.frombuffer(r.sizes, dtype=np.int64))
            ends.append(np.frombuffer(r.ends, dtype=np.int64) + n_bytes)
            numbers.append(np.array([kinds.setdefault(tuple(t), len(kinds)) for t in r.kinds], dtype=np.int64))
            n_bytes += out.write(r.value)
        n_bytes += out.write(b"\0" * (-n_bytes % 8))
        if not hashes:
            return {"name": None}
        h, size, number, end = (np.concatenate(x) for x in (hashes, sizes, numbers, ends))
        order = np.lexsort((h, size))
        for column in (h[order], number[order], end[:-1][order], end[1:][order]):
            out.write(column.tobytes())
    lengths, first = np.unique(size[order], return_index=True)
    return {"name": name, "bytes": n_bytes, "n": len(h), "kinds": list(kinds),
            "lengths": list(zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(h)], strict=True))}


class Dictionary:
    """A file of values, mapped into memory that all tasks of a machine share."""

    def __init__(self, made: dict) -> None:
        data = np.memmap(SparkFiles.get(made["name"]), dtype=np.uint8, mode="r")
        self.text, n = data[: made["bytes"]], made["n"]
        rest = data[made["bytes"] :].view(np.uint64)
        self.hashes, self.numbers, self.begin, self.end = (rest[i * n : (i + 1) * n] for i in range(4))
        self.kinds, self.lengths = made["kinds"], made["lengths"]

    def matches(self, texts: list[str], found: list[list], whole_words: bool) -> None:
        """Add all places of all values to ``found``; those that go on as a word do not count if ``whole_words``."""
        all_texts, longest = Stretches(texts), max(map(len, texts))
        free = ~all_texts.inner() if whole_words else np.ones(len(all_texts.codes) + 1, dtype=bool)
        for size, low, high in self.lengths:
            if size > longest:
                break
            at = np.nonzero(free[: len(free) - size] & free[size:])[0]
            h, known = all_texts.hashes(at, size), self.hashes[low:high]
            place = np.searchsorted(known, h)
            met = np.nonzero(known[np.minimum(place, len(known) - 1)] == h)[0]
            owners = np.searchsorted(all_texts.starts, at[met], side="right") - 1
            for a, i, owner in zip(at[met].tolist(), place[met].tolist(), owners.tolist(), strict=True):
                start = a - int(all_texts.starts[owner])
                value, i = texts[owner][start : start + size], low + i
                h_own, raw = self.hashes[i], value.encode()
                while i < high and self.hashes[i] == h_own:  # values with one hash stand next to each other
                    if bytes(self.text[int(self.begin[i]) : int(self.end[i])]) == raw:
                        found[owner] += [(start, start + size, value, kind) for kind in self.kinds[int(self.numbers[i])]]
                    i += 1


def _stretches(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of the texts that are not empty, of some ``STRETCH`` characters at a time."""
    own, n = [], 0
    for i, text in enumerate(texts):
        if text:
            if own and n + len(text) > STRETCH:
                yield own
                own, n = [], 0
            own.append(i)
            n += len(text)
    if own:
        yield own


def _look_up(texts: DataFrame, files: list[dict], whole_words: bool) -> DataFrame:
    """``texts`` (columns c0, c1, ..., text, found) with the matches of all files in ``found``."""
    names = texts.columns
    at, into = names.index("text"), names.index("found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries = [Dictionary(f) for f in files]
        for batch in batches:
            rows = batch.column(at).to_pylist()
            found = [[] for _ in rows]
            for own in _stretches(rows):
                for d in dictionaries:
                    d.matches([rows[i] for i in own], [found[i] for i in own], whole_words)
            kind = batch.schema.field(into)
            yield batch.set_column(into, kind, pa.array([_longest(f) for f in found], type=kind.type))

    return texts.mapInArrow(run, texts.schema)


def scan_dictionary(
    df: DataFrame,
    values: DataFrame,
    value: str = "value",
    entity_type: str = "entity_type",
    text_col: str = "text",
    spans_col: str = "spans",
    whole_words: bool = True,
    score: float = 1.0,
    max_values: int = MAX_VALUES,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Add ``spans``: where the values of a table stand in the text, each with its entity type.

    All values are looked for at once, in Arrow batches: of each length that values have, the hashes
    of all stretches of the texts are looked up in a sorted file that Spark hands to the executors and
    all tasks of a machine map into memory; hits are confirmed by the value itself. A file holds
    ``max_values`` values and ``max_bytes`` at most; a larger table is dealt out by digest to as many
    files as it takes. Work grows with the texts times the number of different lengths.

    Of matches inside one another the longest counts; partly overlapping ones all do, in order of
    start. A value with several types gives a span for each, by name of the type; rows that repeat
    value and type count once. Empty and null values and values without a type are left out.
    With ``whole_words`` a match may not go on as a word on either side. Null texts have no
    spans; all rows and columns stay. Letters must be the same, case included.
    """
    known = values.select(F.col(value).cast("string").alias("v"), F.col(entity_type).cast("string").alias("t"))
    known = known.filter("v <> '' AND t IS NOT NULL").groupBy("v").agg(F.array_sort(F.collect_set("t")).alias("t"))
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()
    parts = max(1, -(-n // max_values), -(-size // max_bytes))
    names = df.columns
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    texts = df.select(*kept, F.col(text_col).cast("string").alias("text"), F.array().cast(FOUND).alias("found"))
    context, folder, files = df.sparkSession.sparkContext, tempfile.mkdtemp(prefix="veilspan-dictionary-"), []
    for part in range(parts):
        own = known if parts == 1 else known.filter(F.pmod(F.xxhash64("v"), F.lit(parts)) == part)
        made = _file(own, folder)
        if made["name"]:
            context.addFile(os.path.join(folder, made["name"]))
            files.append(made)
    texts = _look_up(texts, files, whole_words)
    spans = F.transform(
        "found",
        lambda f: span_struct(
            entity_type=f["entity_type"], start=f["start"], end=f["end"], score=F.lit(score),
            recognizer=F.lit("dictionary"), pattern=F.lit("dictionary"), pattern_score=F.lit(score), value=f["value"],
        ),
    )
    typed = F.when(F.col("text").isNotNull(), spans.cast(f"array<{SPAN_TYPE}>"))
    empty = F.array().cast(f"array<{SPAN_TYPE}>")
    return texts.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.coalesce(typed, empty).alias(spans_col)
    )
