"""The registry is consistent and the flagship query runs."""

import __spark_entry__ as entry


def test_registry():
    plans, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(plans)
    assert len(plans) > 200


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r["column"] for r in rows} == {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}
