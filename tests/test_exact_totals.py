"""Totals in written documents do not depend on the order in which prices are added."""

import datetime
import itertools

import pytest

from quarry.plans import registry

#: Together 498000; added as doubles they are less in every order.
PRICES = [281842.85, 139843.86, 76313.29]


@pytest.fixture(scope="module")
def orders_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("totals"))
    assert all((a + b) + c < 498000 for a, b, c in itertools.permutations(PRICES))
    day = datetime.datetime(1998, 2, 6)
    spark.createDataFrame([(7, "Customer#7", 2, 10.5, "FURNITURE")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    orders = [(k, 7, "O", price, day, "5-LOW") for k, price in enumerate(PRICES)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name, unit", [("article_facts", "dinars"), ("article_sections", "dinars"), ("contract_fields", "dinars"), ("arabic_facts", "دينار")])
def test_totals_are_exact(spark, orders_dir, name, unit):
    texts = [r["text"] for r in registry.QUERIES[name](spark, orders_dir).collect()]
    assert [x for x in texts if f" 498 {unit}" in x] and not [x for x in texts if "497" in x]
