from pathlib import Path

import pytest

from tests.oracle import DATA, both, connection
from weftdocs.llm import catalog

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, name):
    got, want = both(spark, connection(), catalog.QUERIES[name], catalog.ORACLE[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_has_no_repeats(spark, name):
    rows = [tuple(r) for r in catalog.QUERIES[name](spark, DATA).collect()]
    assert len(rows) == len(set(rows))
