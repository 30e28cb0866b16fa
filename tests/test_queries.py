"""Every query of the library against its SQL on the smallest tables."""

import pytest
from conftest import DATA
from helpers import same

from regionlake import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, duck):
    same(QUERIES[name](spark, DATA), duck, ORACLES[name])


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
