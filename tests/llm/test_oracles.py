"""Operators that SQL can express give the rows of their SQL."""

import pytest

from episodica.llm import queries
from oracle import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows(spark, name):
    names, rows = spark_rows(queries.queries()[name](spark, SF))
    with connect(SF) as con:
        assert (names, rows) == duck_rows(con, queries.oracle_sql()[name])
    assert rows
