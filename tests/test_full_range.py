"""Queries whose feature is not the date window cover orders of every day."""
from rebuyflow.catalog import all_queries
from rebuyflow.catalog.ingest import WINDOW
from tools.compare import oracle_connection

SF = "/root/testdata/sf0.001"


def test_orders_of_every_day_are_counted(spark):
    counted = sum(r["n"] for r in all_queries()["status_map"](spark, SF).collect())
    con = oracle_connection(SF)
    assert counted == con.execute("SELECT count(*) FROM orders").fetchone()[0]
    first, last = WINDOW
    outside = con.execute(f"SELECT count(*) FROM orders WHERE o_orderdate < DATE '{first}' OR o_orderdate > DATE '{last}'").fetchone()[0]
    assert outside > 0
