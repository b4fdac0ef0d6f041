"""URL rules in a sorted array of digests.

Rules (a host with its subdomains, and a path prefix) are hashed with 64-bit xxhash.
The sorted digests lie in a file that every worker maps into memory; a batch of URLs is
probed by one vectorised binary search, and every hit is confirmed against the stored
rule itself, so that two rules or a URL and a rule with one digest do no harm.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts

URL = re.compile(rb"^.*?://([^/?#]*)([^?#]*)", re.DOTALL)
MAX_RULE_BYTES = 256 * 1024 * 1024
SCHEMA = "host string, path string, rule string, verdict string"


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    found = URL.match(url) if url else None
    return (found[1].lower(), found[2]) if found else (b"", b"")


def pack(rules: Iterable[tuple[str, str, str]], folder: str) -> str:
    """Write ``(host, path prefix, verdict)`` rules as one file; gives its path.

    Layout: a JSON head, then digests, text offsets, verdict numbers and the rule
    texts, ordered by digest. Rules that share a digest stand next to each other.
    """
    rows = sorted({(xxhash.xxh64_intdigest(t := (h.lower() + p).encode()), t, v) for h, p, v in rules})
    if len({t for _, t, _ in rows}) < len(rows):
        raise ValueError("one rule has two verdicts")
    if sum(len(t) for _, t, _ in rows) > MAX_RULE_BYTES:
        raise ValueError(f"the rules take more than {MAX_RULE_BYTES} bytes")
    verdicts = sorted({v for *_, v in rows})
    ends = np.cumsum([0, *(len(t) for _, t, _ in rows)], dtype=np.uint64)
    prefixes = sorted({len(t) - t.index(b"/") if b"/" in t else 0 for _, t, _ in rows})
    head = json.dumps({"n": len(rows), "verdicts": verdicts, "prefixes": prefixes}).encode()
    head += b" " * (-len(head) % 8)
    body = b"".join(
        [
            np.uint64(len(head)).tobytes(),
            head,
            np.array([d for d, *_ in rows], dtype=np.uint64).tobytes(),
            ends.tobytes(),
            np.array([verdicts.index(v) for *_, v in rows], dtype=np.uint64).tobytes(),
            b"".join(t for _, t, _ in rows),
        ]
    )
    path = os.path.join(folder, f"url-rules-{hashlib.sha256(body).hexdigest()[:24]}.bin")
    with open(path, "wb") as f:
        f.write(body)
    return path


class RuleArray:
    """A packed rule file, mapped into memory."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, dtype=np.uint8, mode="r")
        size = int(data[:8].view(np.uint64)[0])
        head = json.loads(bytes(data[8 : 8 + size]))
        at, n = 8 + size, head["n"]
        self.verdicts, self.prefixes = head["verdicts"], head["prefixes"]
        self.digests = data[at : at + 8 * n].view(np.uint64)
        self.ends = data[at + 8 * n : at + 16 * n + 8].view(np.uint64)
        self.kinds = data[at + 16 * n + 8 : at + 24 * n + 8].view(np.uint64)
        self.texts = data[at + 24 * n + 8 :]

    def candidates(self, host: bytes, path: bytes) -> list[bytes]:
        """Every text a fitting rule can have, the longest first."""
        if not host:
            return []
        labels = host.split(b".")
        hosts = [b".".join(labels[i:]) for i in range(len(labels))]
        found = {h + path[:size] for h in hosts for size in self.prefixes if size <= len(path)}
        return sorted(found, key=lambda t: (-len(t), t))

    def probe(self, urls: list[tuple[bytes, bytes]]) -> list[tuple[str, str] | None]:
        """The longest fitting rule of each host and path, with its verdict."""
        asked = [self.candidates(h, p) for h, p in urls]
        flat = [t for texts in asked for t in texts]
        keys = np.fromiter((xxhash.xxh64_intdigest(t) for t in flat), dtype=np.uint64, count=len(flat))
        low = np.searchsorted(self.digests, keys, side="left")
        high = np.searchsorted(self.digests, keys, side="right")
        results, at = [], 0
        for texts in asked:
            hit = None
            for i, text in enumerate(texts, at):
                if hit is None and high[i] > low[i]:
                    hit = self._confirm(text, int(low[i]), int(high[i]))
            at += len(texts)
            results.append(hit)
        return results

    def _confirm(self, text: bytes, low: int, high: int) -> tuple[str, str] | None:
        for i in range(low, high):
            if bytes(self.texts[int(self.ends[i]) : int(self.ends[i + 1])]) == text:
                return text.decode(), self.verdicts[int(self.kinds[i])]
        return None


def url_verdicts(
    spark: SparkSession,
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    key: str = "page_id",
    url: str = "url",
    otherwise: str = "allow",
) -> DataFrame:
    """One row per row of ``pages``: ``key``, host, path, rule (null if none fits) and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest rule text wins; ``otherwise`` is the verdict without a rule. Null URLs and
    URLs without ``://`` have empty host and path and no rule. Repeated keys give a row
    each; an empty table gives an empty one; other columns are not read. The rule file
    (at most ``MAX_RULE_BYTES`` of text) goes to the executors once, as a Spark file.
    """
    path = pack(rules, tempfile.mkdtemp(prefix="veilspan-rules-"))
    name = os.path.basename(path)
    if name not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        table = RuleArray(SparkFiles.get(name))
        for keys, urls in batches:
            parts = [split_url(u) for u in urls]
            hits = table.probe(parts)
            yield [
                keys,
                [h.decode("utf-8", "replace") for h, _ in parts],
                [p.decode("utf-8", "replace") for _, p in parts],
                [h[0] if h else None for h in hits],
                [h[1] if h else otherwise for h in hits],
            ]

    kind = pages.schema[key].dataType.simpleString()
    return map_texts(pages, [key, url], work, f"`{key}` {kind}, {SCHEMA}")
