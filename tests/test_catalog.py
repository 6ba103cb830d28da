"""Every engine query against DuckDB."""

import pytest
from compare import same
from conftest import DATA

from tidewheel import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    same(catalog.queries()[name](spark, DATA), duck.sql(ORACLES[name]))


WINDOWED = catalog.windowed_sql()


@pytest.mark.parametrize("name", sorted(catalog.windowed()))
def test_windowed(spark, duck, name):
    same(catalog.windowed()[name](spark, DATA), duck.sql(WINDOWED[name]))
