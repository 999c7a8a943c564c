"""Every registered query of the reference's operators against its SQL."""

import pytest

from netloom import catalog
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_same_as_sql(spark, small, con, name):
    assert not differences(spark, small, catalog.QUERIES[name], catalog.ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
