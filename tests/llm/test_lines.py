"""Line dedup: groups, blocks, verification, odd rows."""

import random
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import PROSE, rows_of
from tests.llm.test_line_recall import slow_dedup, word_distance
from veilspan.llm import fuzzy_lines as fl
from veilspan.llm.common import shared_folder


def test_fuzzy_groups(docs_of):
    """Lines with a word changed here and there, some of them met through a third line."""
    words = [f"{w}{i}" for i in range(4) for w in PROSE.split()]
    lines = [" ".join(words)]
    for i in range(30):
        changed = list(words)
        changed[(7 * i) % len(words)] = f"other{i}"
        lines.append(" ".join(changed))
    lines += [" ".join(reversed(words)), " ".join(words).upper() + "!"]
    texts = {i: f"{line}\nshort one\n{i} keeps a line of its own here" for i, line in enumerate(lines)}
    got = {r.doc_id: r.text for r in fl.deduplicated_lines(docs_of(*texts.values())).collect()}
    assert got == slow_dedup(texts)
    assert sum(words[0] in t for t in got.values()) < 10
    assert " ".join(reversed(words)) in got[31]


def slow_blocks(words):
    """Neighbouring words of each block, in the order that blocks follow."""

    def number(word):
        h = xxhash.xxh64_intdigest(word.encode(), 42) & (1 << 63) - 1
        return h - (1 << 63) if len(word.encode()) >= fl.LONG_WORD else h

    h, out = sorted(map(number, words)), []
    if fl.MIN_WORDS <= len(h) <= fl.ALIKE_SHORT:
        out += [tuple(h[i : i + 2]) for i in range(min(len(h) - 1, fl.SHORT_BLOCKS))]
    if len(h) > fl.SHORT_LINE:
        points = [k * ((1 << 63) // fl.BLOCKS) - (1 << 63) for k in range(fl.BLOCKS)]
        starts = dict.fromkeys(sum(x < point for x in h) for point in points)
        out += [tuple(h[(i + j) % len(h)] for j in range(3)) for i in starts]
    return out


def test_blocks(spark):
    """Blocks are equal where, and only where, their words are; each bit of three is that of two."""
    draw = random.Random(5)
    vocabulary = [f"{'long' * draw.randrange(2)}{i}" for i in range(60)]
    lines = [draw.choices(vocabulary[: draw.randrange(3, 60)], k=n) for n in range(1, 45) for _ in range(4)]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, w array<string>").select("i", fl.simhash_blocks(F.col("w")).alias("b"))
    meaning = {}
    for r in rows.collect():
        expected = slow_blocks(lines[r.i])
        assert len(r.b) == len(expected)
        for key, words in zip(r.b, expected, strict=True):
            assert meaning.setdefault(key, words) == words
            if len(set(words)) == 3:
                a, b, c = words
                assert key == (a & b | a & c | b & c) & (1 << fl.BLOCK_BITS) - 1


@pytest.mark.parametrize("symbols", [1 << 20, 2, 1])
def test_unlike_words_with_one_symbol(docs_of, monkeypatch, symbols):
    """However few symbols there are, lines are compared by their words."""
    monkeypatch.setattr(fl, "SYMBOLS", symbols)
    lines = ["alpha beta gamma delta epsilon zeta", "alpha beta gamma other words here", "alpha beta gamma delta epsilon eta", "one two three four five"]
    got = [r.text for r in fl.deduplicated_lines(docs_of(*lines)).orderBy("doc_id").collect()]
    assert got == [lines[0], lines[1], "", lines[3]]


def test_many_lines_with_one_shared_run(spark):
    """Comparisons grow with the lines, not with their square."""
    draw, counts = random.Random(6), []
    for n in (500, 1000, 2000):
        lines = [[f"unlike{draw.randrange(10**9)}" for _ in range(6)] for _ in range(n)]
        lines = [[*w[:3], *"at the end of the long government building".split(), *w[3:]] for w in lines]
        table = spark.createDataFrame([(i, w) for i, w in enumerate(lines)], "id long, w array<string>")
        distinct = table.select("id", F.size("w").alias("n"), fl.simhash_blocks(F.col("w")).alias("blocks"))
        counts.append(fl.candidate_pairs(fl._members(distinct)).count())
    assert 0 < counts[0] < 20 * 500 and counts[2] < 5 * counts[0]


def test_large_group_of_variants(docs_of):
    """Hundreds of variants of one line, and unlike lines that share its rarest words."""
    words = PROSE.split()
    texts = []
    for i in range(300):
        changed = list(words)
        changed[i % len(words)] = f"changed{i}"
        texts.append(" ".join(changed))
    got = [r.text for r in fl.deduplicated_lines(docs_of(*texts)).collect()]
    assert sum(t != "" for t in got) == 1


def test_odd_rows(odd_docs, no_docs):
    got = fl.deduplicated_lines(odd_docs)
    assert rows_of(got, "doc_id", "n_lines", "n_kept") == sorted(
        [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 2, 2), (4, 1, 0), (4, 1, 0), (None, 2, 2), (7, 4, 4)], key=repr
    )
    whole = fl.without_repeats(odd_docs)
    assert whole.columns == odd_docs.columns and whole.count() == 8
    assert whole.filter("doc_id IS NULL AND text LIKE 'no key%harbour%'").count() == 1
    assert fl.deduplicated_lines(no_docs).count() == 0


def test_repeats_inside_one_document(docs_of):
    text = f"{PROSE}\nof.\n{PROSE}\n\nof."
    got = fl.without_repeats(docs_of(text)).first().text
    assert got == f"{PROSE}\nof.\n"



def test_alike_lines_amid_many_unlike_ones(spark):
    """Under one block: pairs far from its first and last lines, and a line met through one that is done."""
    unlike = lambda i: [f"u{i}w{j}" for j in range(10)]
    lines = [unlike(i) for i in range(20)]
    lines += [[*unlike(i)[:-1], "other"] for i in range(8, 12)]
    lines += [[*unlike(0)[:-k], *["new"] * k] for k in (2, 4)]
    lines += [unlike(i) for i in range(20, 30)]
    rows = [(i, len(w), i, i, [1], " ".join(w)) for i, w in enumerate(lines)]
    distinct = spark.createDataFrame(rows, "id long, n int, h1 long, h2 long, blocks array<long>, body string")
    links = [(r.a, r.b) for r in fl.fuzzy_links(distinct, distinct).collect()]
    assert sorted(set(links)) == [(20, 8), (21, 9), (22, 10), (23, 11), (24, 0), (25, 24)]


def test_pairs_apart_are_all_that_can_be_alike(spark, monkeypatch):
    """Against edit distance over all pairs, with repeated words, on one large block dealt out to parts."""
    monkeypatch.setattr(fl, "DEALT", 2)
    draw = random.Random(10)
    lines = [[f"word{draw.randrange(9)}" for _ in range(draw.randrange(5, 16))] for _ in range(100)]
    for words in list(lines):
        edits = [draw.choice([[], [w], [w, "word1"], ["word2"]]) if draw.random() < 0.2 else [w] for w in words]
        lines.append(sum(edits, []))
    bodies = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "id long, body string")
    apart = bodies.select(F.lit(1).alias("block"), "id", F.size(F.split("body", " ")).alias("n"), F.col("id").alias("component"))
    got = {(r.a, r.b) for r in fl._pairs_apart(apart, bodies).collect()}
    limit = lambda x, y: 0.2 * max(len(x), len(y)) + 1e-9
    expected = {(a, b) for a, x in enumerate(lines) for b, y in enumerate(lines[:a]) if word_distance(x, y) <= limit(x, y)}
    assert expected and expected <= got


def test_pairs_apart_come_out_once(spark, monkeypatch):
    """However many blocks and rare words two lines share; without their first keys, under each of them."""
    lines = [[*[f"same{j}" for j in range(40)], *[f"own{i}w{j}" for j in range(5)]] for i in range(20)]
    bodies = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "id long, body string")
    apart = bodies.select(F.explode(F.array(*map(F.lit, range(6)))).alias("block"), "id", F.lit(45).alias("n"), F.col("id").alias("component"))
    pairs = [(a, b) for a in range(20) for b in range(a)]
    assert sorted(map(tuple, fl._pairs_met(apart, bodies).collect())) == pairs
    monkeypatch.setattr(fl, "FIRST_KEYS", 0)
    again = sorted(map(tuple, fl._pairs_met(apart, bodies).collect()))
    assert len(again) > 6 * len(pairs) and sorted(set(again)) == pairs


def test_rare_words_are_worked_out_once(spark):
    """Not in a filter on empty arrays, which would go below the join and do all lines once more."""
    bodies = spark.createDataFrame([(0, "a b c d e", [1, 2, 3, 4, 5])], "id long, body string, codes array<int>")
    apart = spark.createDataFrame([(7, 0, 0)], "block long, id long, component long")
    plan = fl._shared_keys(apart, bodies, bytes(1 << fl.CLASS_BITS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == plan.count("explode(") > 0


def test_few_lines_under_a_block_are_compared_by_signs(spark):
    """Against edit distance over all pairs: none that is alike is lost, and few that are not are left."""
    draw = random.Random(11)
    lines = [[f"{'long' * draw.randrange(2)}{draw.randrange(10**6)}" for _ in range(draw.randrange(5, 60))] for _ in range(60)]
    for words in list(lines):
        edits = [draw.choice([[], [w, "another"], ["replaced"]]) if draw.random() < 0.15 else [w] for w in words]
        lines.append(sum(edits, []))
    rows = [(i, " ".join(w), len(w), i, i) for i, w in enumerate(lines)]
    table = spark.createDataFrame(rows, "id long, body string, n int, h1 long, h2 long")
    members = table.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("block"), "id")
    pairs = [(r.a, r.b) for r in fl._few_pairs(members, fl._marks(table, table)).collect()]
    limit = lambda x, y: 0.2 * max(len(x), len(y)) + 1e-9
    alike = {(a, b) for a, x in enumerate(lines) for b, y in enumerate(lines[:a]) if word_distance(x, y) <= limit(x, y)}
    assert alike and alike <= set(pairs)
    assert len(pairs) == len(set(pairs)) < 3 * len(alike)


def test_links_between_few_lines_are_all_found(spark):
    """A line whose smallest possible partner is none by its words, and one met through another line only."""
    words = [f"words{i}" for i in range(10)]
    changed = lambda k: [*words[:-k], *["new"] * k]
    lines = [list(reversed(words)), words, changed(2), changed(4), [f"apart{i}" for i in range(10)]]
    rows = [(i, len(w), i, i, [1], " ".join(w)) for i, w in enumerate(lines)]
    distinct = spark.createDataFrame(rows, "id long, n int, h1 long, h2 long, blocks array<long>, body string")
    assert {(r.a, r.b) for r in fl.fuzzy_links(distinct, distinct).collect()} == {(2, 1), (3, 2)}


def test_tables_of_lines_go(spark, docs_of):
    """Nothing that only the work needs takes disk while the result is written."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    got = fl.deduplicated_lines(docs_of(PROSE, f"{PROSE} more", "a line of its own words here"))
    assert sorted(r.text for r in got.collect()) == ["", "a line of its own words here", PROSE]
    names = ("lines-", "distinct-lines-", "line-blocks-", "line-bodies-")
    assert not [p.name for p in set(folder.iterdir()) - before if p.name.startswith(names)]
