"""Repetition rules, licence rules and URL rules against plain versions."""

import re
from collections import Counter

import pytest

from tests.compare import compare, connect
from tests.llm.conftest import PROSE, rows_of
from veilspan.llm import license_rules, queries, repetition, url_filter


def slow_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))

    def inside(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        often = Counter(grams)
        return {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(n)}

    seen, dup_lines, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own and line in seen:
            dup_lines += 1
            dup_chars += sum(map(len, own))
        seen.add(line)
    repeat = len(inside(3))
    grams = {n: sum(len(words[i]) for i in inside(n)) for n in range(5, 11)}
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    limits = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
    kept = not failed and 100 * dup_chars <= 20 * chars and all(100 * grams[n] <= x * chars for n, x in limits.items())
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return (len(words), chars, symbols, dup_lines, repeat, failed, kept, dup_chars, *grams.values())


def test_repetition_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r[0]: tuple(r[1:]) for r in repetition.repetition_rules(docs).collect()}
    assert got == {k: slow_measure(t) for k, t in texts.items()}
    kept = repetition.keep_good(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v[6]}


def test_repetition_of_odd_rows(odd_docs, no_docs):
    texts = [PROSE + " " + PROSE, "a\nb b\na\n\n\na", "é 😀é\n" * 70, "x\u00a0y z\u2003z " * 60]
    for text in texts:
        assert tuple(repetition.measure(text.encode())) == slow_measure(text)
    got = repetition.repetition_rules(odd_docs)
    assert got.count() == 8 and {r.kept for r in got.filter("doc_id IN (0, 1, 2)").collect()} == {False}
    kept = repetition.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert rows_of(kept, "doc_id") == sorted([(3,), (4,), (4,), (None,)], key=repr)
    assert repetition.repetition_rules(no_docs).count() == 0 and repetition.keep_good(no_docs).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same, note = compare(spark, connect(sf_dir), sf_dir, name)
    assert same, note


def full(*names):
    return "\n".join(license_rules.SENTENCES[n] for n in names)


def test_licences_in_texts(docs_of):
    wrapped = re.sub(r"(.{30,60}) ", r"\1\n * ", license_rules.SENTENCES["mit-grant"])
    texts = {
        "": "no such thing; permission is not granted",
        "MIT": f"Copyright (c) someone\n\n{wrapped}\n\n{full('mit-notice', 'mit-warranty')}",
        "BSD-3-Clause": full("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"),
        "BSD-2-Clause": full("bsd-grant", "bsd-source", "bsd-binary"),
        "CC-BY-NC-4.0": "first line without an end\nLicensed under CC BY-NC 4.0.\nmore",
        "Apache-2.0,GPL-3.0-only": full("apache-short") + " some words. " + full("gpl3-short"),
        "GPL-3.0-or-later": full("gpl3-later", "gpl-warranty"),
        "GPL-2.0-or-later": full("gpl2-later"),
    }
    got = {r.doc_id: r.licenses for r in license_rules.licences(docs_of(*texts.values())).collect()}
    assert got == dict(enumerate(texts))


def test_licence_order_matters(docs_of):
    turned = full("bsd-binary", "bsd-source", "bsd-grant")
    row = license_rules.licences(docs_of(turned)).first()
    assert row.licenses == "" and row.sentence_ids == "bsd-binary,bsd-source,bsd-grant"


def test_licences_of_odd_rows(odd_docs, no_docs):
    got = license_rules.licences(odd_docs)
    assert got.count() == 8 and {tuple(r)[1:] for r in got.collect()} == {("", "")}
    assert license_rules.licences(no_docs).count() == 0


def slow_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, *best


URLS = [
    None, "", "nothing", "://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en",
    "http://a.example.com/en/1", "http://notexample.com/en/", "http://x.net/es/?a=/fr/", "http://net/fr/#x",
    "http://x.net/de/", "http://É.com/é", "a://b://c.com/", "http://x.com?y=/en/", "http://x.com\n/en/", "http:// com/",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "a", "b") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = url_filter.url_verdicts(spark, pages, queries.URL_RULES)
    assert rows_of(got, *got.columns) == sorted(
        ((i, *slow_verdict(u, queries.URL_RULES)) for i, u in enumerate(URLS)), key=repr
    )
    assert url_filter.url_verdicts(spark, pages.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(spark, pages, [], otherwise="block").collect()} == {"block"}


def test_colliding_digests_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda t: len(t) % 2)
    rules = [(f"h{i}.org", "/" * (i % 3), "block" if i % 2 else "allow") for i in range(40)]
    table = url_filter.RuleArray(url_filter.pack(rules, str(tmp_path)))
    asked = [(f"x.h{i}.org".encode(), b"//") for i in range(45)]
    expected = [slow_verdict(f"http://x.h{i}.org//", rules)[2:] for i in range(45)]
    assert [h or (None, "allow") for h in table.probe(asked)] == expected


def test_bad_rules(tmp_path):
    with pytest.raises(ValueError, match="two verdicts"):
        url_filter.pack([("a.b", "/", "allow"), ("A.b", "/", "block")], str(tmp_path))
