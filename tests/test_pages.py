"""The paged queries where a page can be full: at the next scale up."""

import pytest
from compare import connection, difference

from driftline.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"
PAGED = sorted(name for name, sql in ORACLES.items() if " LIMIT " in sql)


@pytest.mark.parametrize("name", PAGED)
def test_page(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connection(FOLDER), ORACLES[name]) is None
