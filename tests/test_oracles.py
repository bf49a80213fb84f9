"""Every registered query against its SQL counterpart on the small tables."""

import pytest

from checks import compare, oracle, queries


def test_every_query_has_a_counterpart():
    assert set(queries.QUERIES) == set(oracle.ORACLES)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, name):
    result = compare.compare(spark, sf, [name])[name]
    assert result.startswith("ok"), result


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.queries()) >= set(driver.oracle_sql())
