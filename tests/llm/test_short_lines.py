"""Lines that are too short for fuzzy comparison, and lines of scripts without spaces."""

import pytest

from tests.llm.conftest import PROSE
from tests.llm.test_line_recall import slow_dedup
from veilspan.llm import fuzzy_lines as fl


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = slow_dedup({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.text for r in fl.deduplicated_lines(docs).collect()} == expected


@pytest.mark.parametrize("line", ["All rights reserved.", "Home", "* * *", "版权所有不得转载"])
def test_short_lines(docs_of, line):
    docs = docs_of(f"{PROSE}\n{line}", f"{line}\n\n \nanother one\n{line}")
    assert [r.text for r in fl.without_repeats(docs).orderBy("doc_id").collect()] == [f"{PROSE}\n{line}", "\n \nanother one"]


def test_scripts_without_spaces(docs_of):
    docs = docs_of("春眠不觉晓处处闻啼鸟夜来风雨声", "春眠不觉晓处处闻啼鸟夜来风雪声", "白日依山尽黄河入海流")
    assert [r.text != "" for r in fl.without_repeats(docs).orderBy("doc_id").collect()] == [True, False, True]
