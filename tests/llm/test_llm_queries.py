import pytest
from compare import compare, duck

from chainloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, small, name):
    rows, same = compare(spark, duck(small), name, queries.queries()[name], SQL.get(name), small)
    assert same or name not in SQL
    if name not in ("p8_found",):
        assert rows > 0
