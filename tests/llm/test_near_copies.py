"""Near copies against brute force over all pairs of texts by exact shingles."""

import corpus_pipeline
from tests.llm.conftest import PROSE, rows_of
from veilspan.llm.near_copies import near_links, one_of_each_near, sketch, sketches


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike_pairs(texts):
    """Pairs of keys whose texts have a similarity of 0.8 or more."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    found, by_shingle = set(), {}
    for k in sorted(sets):
        met = {o for s in sets[k] for o in by_shingle.get(s, ())}
        for o in met:
            if 5 * len(sets[k] & sets[o]) >= 4 * len(sets[k] | sets[o]):
                found.add((o, k))
        for s in sets[k]:
            by_shingle.setdefault(s, []).append(k)
    return found


def slow_kept(texts):
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in alike_pairs(texts):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {k for k in texts if find(k) == k}


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = one_of_each_near(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == slow_kept(texts)


def test_edited_sentence(spark, docs_of):
    """Copies with a few words replaced, and one with too many; a group of which few are like the first."""
    base = [f"{w}{i}" for i in range(4) for w in PROSE.split()]
    texts = [" ".join(base)]
    for n in (1, 3, 4, 60):
        texts.append(" ".join(f"new{i}" if 100 <= i < 100 + n else w for i, w in enumerate(base)))
    for i in range(12):
        texts.append(" ".join(f"other{i}" if at % 100 == 8 * i else w for at, w in enumerate(base)))
    docs = docs_of(*texts)
    rows = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()}
    assert got == slow_kept(dict(enumerate(texts))) and 0 in got and not got & {1, 2, 3}


def test_odd_rows(odd_docs, no_docs, docs_of):
    kept = one_of_each_near(odd_docs)
    assert kept.columns == odd_docs.columns
    assert rows_of(kept, "doc_id") == sorted([(0,), (3,), (4,), (4,), (7,), (None,)], key=repr)
    assert one_of_each_near(no_docs).count() == 0
    same_key = docs_of("a b c", "a b c", PROSE, keys=[1, 2, 2])
    assert rows_of(one_of_each_near(same_key), "doc_id", "text") == [(1, "a b c"), (2, PROSE)]


def test_near_prints_meet_without_bands(docs_of):
    """Texts whose SimHash prints differ by up to two bits are found by their prints alone, and verified."""
    words = [f"w{i}" for i in range(1500)]
    bits = lambda t: (sketch(t.encode())[2] ^ sketch(" ".join(words).encode())[2]) & (1 << 64) - 1
    texts = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(0, 1500, 50)]
    near = [t for t in texts if bits(t).bit_count() <= 2]
    docs = docs_of(" ".join(words), *near, " ".join(reversed(words)))
    rows = docs.selectExpr("doc_id AS key", "xxhash64(text) AS h", "text AS body")
    prints = sketches(rows).selectExpr("key AS id", "key", "digest", "n", "sim", "array(key) AS bands").localCheckpoint()
    links = {(r.a, r.b) for r in near_links(rows, prints).collect()}
    reached = {0}
    for _ in range(len(near)):
        reached |= {x for pair in links if set(pair) & reached for x in pair}
    assert len(near) > 3 and reached == set(range(len(near) + 1))
