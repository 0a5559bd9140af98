"""Every query of the core against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

from tests.oracle import DATA, both, connection
from weftdocs import catalog

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, con, name):
    got, want = both(spark, con, catalog.QUERIES[name], catalog.ORACLE[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0
