import oracle
import pytest

from lattis.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, con, data, name):
    assert oracle.difference(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name], data) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
