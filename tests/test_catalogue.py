"""Every catalogue query gives the rows of its SQL."""

import pytest

from episodica.plans import catalogue
from oracle import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    with connect(SF) as held:
        yield held


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_rows(spark, con, name):
    names, rows = spark_rows(catalogue.queries()[name](spark, SF))
    assert (names, rows) == duck_rows(con, catalogue.oracle_sql()[name])
    assert rows
