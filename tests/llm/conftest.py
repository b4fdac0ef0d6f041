from __future__ import annotations

import pytest

PROSE = (
    "the old harbour lay quiet under a pale winter sun while the last boats came home one by one "
    "carrying nets and baskets full of silver fish for the market by the square where children were "
    "waiting with their mothers and an organ grinder played slow tunes that nobody knew any more but "
    "all of them hummed along until evening fell over roofs and chimneys"
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with keys 0, 1, ... (or given ones) and columns whose names clash with results."""

    def build(*texts, keys=None):
        keys = list(range(len(texts))) if keys is None else keys
        rows = [(k, t, "x", 7, True, [1], "l") for k, t in zip(keys, texts, strict=True)]
        schema = "doc_id long, text string, key string, n_words int, kept boolean, ids array<int>, line string"
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Null and empty texts, a very long one, repeated rows, a missing key."""
    long = " ".join(f"w{i}" for i in range(60_000)) + "\n" + PROSE
    texts = [None, "", " \n\t ", long, PROSE, PROSE, "no key here at all\n" + PROSE, "é ß 😀\n\n\nlast line"]
    return docs_of(*texts, keys=[0, 1, 2, 3, 4, 4, None, 7])


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
