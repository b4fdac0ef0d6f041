"""Containment search against all pairs of items and documents."""

import random

from tests.llm.conftest import PROSE, rows_of
from veilspan.llm import containment as ct


def slow_hits(docs, items):
    found = set()
    for item, text in items.items():
        words = text.lower().split()
        width = min(5, len(words))
        wanted = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()
        for key, body in docs.items():
            own = body.lower().split()
            shared = len(wanted & {tuple(own[i : i + width]) for i in range(len(own) - width + 1)})
            if wanted and 10 * shared >= 8 * len(wanted):
                found.add((key, item, shared, len(wanted), shared / len(wanted)))
    return found


def test_changed_passages(spark, docs_of, monkeypatch):
    draw = random.Random(2)
    words = [f"v{i}" for i in range(300)]
    items = {i: " ".join(draw.choices(words, k=draw.choice([1, 2, 4, 5, 6, 9, 20, 60, 200]))) for i in range(60)}
    docs = {}
    for key in range(120):
        own = items[draw.randrange(60)].split()
        for _ in range(draw.randrange(0, 4)):
            own[draw.randrange(len(own))] = "CHANGED"
        around = draw.choices(words, k=draw.randrange(0, 3000))
        at = draw.randrange(0, len(around) + 1)
        docs[key] = " ".join(around[:at]) + "\n" + " \t".join(own) + " " + " ".join(around[at:]).upper()
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = ct.contained_items(docs_of(*docs.values()), table)
    assert {tuple(r) for r in got.collect()} == slow_hits(docs, items)
    monkeypatch.setattr(ct, "BLOCK_ITEMS", 7)
    again = ct.contained_items(docs_of(*docs.values()), table)
    assert rows_of(again, *again.columns) == rows_of(got, *got.columns)
    clean = ct.clean_documents(docs_of(*docs.values()), table)
    assert {r.doc_id for r in clean.collect()} == docs.keys() - {r[0] for r in slow_hits(docs, items)}


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, PROSE), (1, PROSE.upper()), (2, None), (3, ""), (None, "last LINE")], "item_id long, text string")
    got = ct.contained_items(odd_docs, items)
    assert rows_of(got, "doc_id", "item_id") == sorted(
        [(3, 1), (3, 1), *[(4, 1)] * 4, (None, 1), (None, 1), (7, None)], key=repr
    )
    clean = ct.clean_documents(odd_docs, items)
    assert clean.columns == odd_docs.columns and rows_of(clean, "doc_id") == [(0,), (1,), (2,)]
    none = items.limit(0)
    assert ct.contained_items(odd_docs, none).count() == 0 and ct.clean_documents(odd_docs, none).count() == 8
    assert ct.contained_items(no_docs, items).count() == 0
