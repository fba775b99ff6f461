import pytest
from compare import compare, duck

import __spark_entry__ as entry
from chainloom.plans import catalog, problems

QUERIES = problems.queries() | catalog.queries()
SQL = problems.oracle_sql() | catalog.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, name):
    rows, same = compare(spark, duck(small), name, QUERIES[name], SQL.get(name), small)
    assert same or name not in SQL
    assert rows > 0


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["p2_found"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<address:string>" in plan
    plan = QUERIES["dsha256"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,scriptpubkey:binary>" in plan and "*(1)" in plan
    plan = QUERIES["chain_tx_out"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNull(dropped_at)" in plan
    for name in ("balances", "utxo_set", "p2_address_totals", "spent_flag"):
        assert "SinglePartition" not in QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
