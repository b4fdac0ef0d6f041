"""Line dedup against brute force by edit similarity alone, and lines that are too short for it."""

import random
import re

from veilspan.llm import fuzzy_lines as fl


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_dedup(texts):
    """Texts by key without repeated lines: all pairs of lines with a shared word, by edit distance only."""
    places = {}
    for key in sorted(texts):
        for no, line in enumerate((texts[key] or "").split("\n")):
            words = tuple(re.sub(r"[\W_]+", " ", line.lower()).split()) or tuple("".join(line.split()))
            if words:
                places.setdefault(words, []).append((key, no))
    root = {w: w for w in places}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    by_word = {}
    for a in places:
        if len(a) < fl.MIN_WORDS or not re.search(r"\w", a[0]):
            continue
        # one of the words that must stay is among any fifth of them and one more
        few = sorted(set(a), key=lambda w: (len(by_word.get(w, ())), w))
        for b in {b for w in few for b in by_word.get(w, ())}:
            most = 0.2 * max(len(a), len(b)) + 1e-9
            if abs(len(a) - len(b)) <= most and len(set(a) - set(b)) <= most and word_distance(a, b) <= most:
                root[find(a)] = find(b)
        for w in few:
            by_word.setdefault(w, []).append(a)
    groups = {}
    for w, where in places.items():
        groups.setdefault(find(w), []).extend(where)
    gone = {p for where in groups.values() for p in where if p != min(where)}
    return {
        k: "\n".join(x for no, x in enumerate((t or "").split("\n")) if (k, no) not in gone) for k, t in texts.items()
    }


def kept(texts):
    return sum(t != "" for t in texts.values())


def test_recall_at_the_limit(docs_of):
    """Every length up to 80 with a fifth of the words replaced or taken out, at random: nine in ten are found."""
    draw, lines = random.Random(3), []
    for n in range(5, 81):
        words = [f"l{n}word{i}" if i % 3 else f"{i}" for i in range(n)]
        where = set(draw.sample(range(n), n // 5))
        lines += [words, [f"other{n}x{i}" if i in where else w for i, w in enumerate(words)]]
        lines += [[w for i, w in enumerate(words) if i not in where]] if n > 5 else []
    texts = {i: " ".join(line) for i, line in enumerate(lines)}
    got = {r.doc_id: r.text for r in fl.deduplicated_lines(docs_of(*texts.values())).collect()}
    expected = slow_dedup(texts)
    assert all(t in ("", texts[k]) for k, t in got.items())
    assert len(texts) - kept(got) >= 0.9 * (len(texts) - kept(expected))


def test_short_lines_are_all_found(docs_of):
    """Up to 14 words no alike pair is missed, whatever a fifth of the words becomes."""
    draw, lines = random.Random(8), []
    for n in range(5, 15):
        for k in range(6):
            words = [f"l{n}k{k}w{i}" for i in range(n)]
            where = set(draw.sample(range(n), n // 5))
            lines += [words, [f"y{k}{i}" if i in where else w for i, w in enumerate(words)]]
    texts = {i: " ".join(line) for i, line in enumerate(lines)}
    got = {r.doc_id: r.text for r in fl.deduplicated_lines(docs_of(*texts.values())).collect()}
    assert got == slow_dedup(texts)
