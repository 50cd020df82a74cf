"""Every query of the catalogue against its SQL, or at least to its end."""

import pytest

import __spark_entry__
from corpusmill.plans import catalog
from tests.helpers import SMALL, assert_matches


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    if name in catalog.SQL:
        assert_matches(df, catalog.SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
