"""Every query against its SQL on whole tables."""

import pytest

from __spark_entry__ import entry
from tests.compare import compare
from veilspan.plans.catalog import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert name in oracle_sql(), f"{name} has no SQL"
    same, note = compare(spark, duck, sf_dir, name)
    assert same, note


def test_entry(spark):
    assert entry(spark).count() == 200
