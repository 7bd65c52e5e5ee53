"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.check import compare, duck
from waymark import plans

QUERIES, ORACLES = plans.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) in (None, "EMPTY")
    else:
        assert df.count() > 0
