"""SimHash groups against brute force over all pairs of fingerprints."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import PROSE, rows_of
from veilspan.llm import simhash_dedup as sd
from veilspan.llm.components import components


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Smallest key reachable of each key; ``prints`` maps keys to fingerprints."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_fingerprints(spark, odd_docs, sf_dir):
    texts = [r.text for r in odd_docs.collect()] + ["One", "one TWO", "a b c", "É a B c d"]
    for text in texts:
        assert sd.fingerprint(text and text.encode()) & (1 << 64) - 1 == slow_fingerprint(text)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    groups = slow_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sd.simhash_components(docs).collect()}
    assert got == {k: (f"{prints[k]:016x}", groups[k]) for k in prints}


def test_links_connect_near_fingerprints(spark, monkeypatch):
    """Chains and a crowd around one fingerprint, through pairs and through neighbours."""
    draw = random.Random(5)
    prints = {draw.getrandbits(64) for _ in range(40)}
    for _ in range(3):
        start = at = draw.getrandbits(64)
        prints |= {start ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64) for _ in range(60)}
        for _ in range(12):
            at ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
            prints.add(at)
    prints = dict(enumerate(sorted(prints)))
    expected = slow_components(prints)
    table = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in prints.items()], "id long, fp long")
    for limit in (256, 8):
        monkeypatch.setattr(sd, "LARGE_GROUP", limit)
        links = sd.near_links(table)
        assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 2 for r in links.collect())
        found = {r.id: r.component for r in components(links, "a", "b").collect()}
        assert {k: found.get(k, k) for k in prints} == expected


def test_discards_by_distance_table(spark):
    """Distances to all references differ by no more than the fingerprints do."""
    table = sd.pivot_table(spark.createDataFrame([(0,), (3,), (-1,), (1 << 40,)], "fp long")).collect()
    for a in table:
        for b in table:
            apart = ((a.fp ^ b.fp) & (1 << 64) - 1).bit_count()
            assert max(abs(x - y) for x, y in zip(a["at"], b["at"], strict=True)) <= apart


def test_odd_rows(odd_docs, no_docs):
    got = rows_of(sd.simhash_components(odd_docs), "doc_id", "component_id")
    assert got == sorted([(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (4, 4), (None, None), (7, 7)], key=repr)
    assert sd.simhash_components(no_docs).count() == 0
    kept = sd.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert rows_of(kept, "doc_id") == sorted([(0,), (3,), (4,), (4,), (7,), (None,)], key=repr)


def test_copies_and_near_copies(docs_of):
    base = " ".join(f"{w}{i}" for i in range(12) for w in PROSE.split())
    near = base.replace("harbour3", "haven3", 1)
    got = rows_of(sd.simhash_components(docs_of(base, "other words " + PROSE, base.upper(), near)), "doc_id", "component_id")
    assert got == [(0, 0), (1, 1), (2, 0), (3, 0)]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 50)] + [(100, 100), (None, 3)]
    links = spark.createDataFrame(path + star, "a long, b long").repartition(4)
    got = {r.id: r.component for r in components(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)}
    assert components(links.filter(F.lit(False)), "a", "b").count() == 0
