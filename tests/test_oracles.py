"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from evalspark.plans import registry
from tests.compare import connection, rows

registry.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.ORACLES:
        assert rows(got) == rows(con.sql(registry.ORACLES[name]).df())
    else:
        assert len(got)
