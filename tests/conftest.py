from __future__ import annotations

import pytest

from tests.compare import connect, make_session


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="session")
def texts(spark):
    """Builds a table of texts with keys 0, 1, 2, ..."""

    def build(*values):
        return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")

    return build
