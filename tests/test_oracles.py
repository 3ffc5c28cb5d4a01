"""Every registered query against its check in SQL, on the smallest tables."""

import pytest
from compare import compare, connect

from tidemark.plans import load_all

SF_DIR = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_check(spark, con, name):
    _, verdict = compare(spark, con, QUERIES[name], SF_DIR)
    assert verdict in ("ok", "rows only"), verdict
