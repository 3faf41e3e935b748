"""A hot customer (a third of all lines) and a hot order: results stay whole
and exact; the pair shuffle is keyed on (customer, part), not the customer."""

import datetime as dt
import os
import tempfile

import numpy as np
import pandas as pd
import pytest

from patronus.operators import rfm
from patronus.sources.tables import tables


@pytest.fixture(scope="module")
def skewed_dir():
    rng = np.random.default_rng(11)
    d = tempfile.mkdtemp(prefix="patronus-skew-")
    n_orders, n_cust = 600, 50
    cust = np.where(np.arange(n_orders) < 200, 1, rng.integers(2, n_cust + 1, n_orders))  # customer 1: 1/3
    orders = pd.DataFrame({"o_orderkey": np.arange(1, n_orders + 1, dtype="int64"),
                           "o_custkey": cust.astype("int64"),
                           "o_orderdate": [dt.datetime(2020, 1, 1) + dt.timedelta(days=int(x))
                                           for x in rng.integers(0, 400, n_orders)]})
    lines_per = np.where(orders.o_orderkey == 7, 300, rng.integers(1, 5, n_orders))        # a hot order
    ok = np.repeat(orders.o_orderkey.to_numpy(), lines_per)
    li = pd.DataFrame({"l_orderkey": ok, "l_partkey": rng.integers(1, 80, len(ok)).astype("int64"),
                       "l_quantity": rng.integers(1, 50, len(ok)).astype(float),
                       "l_extendedprice": np.round(rng.uniform(1, 1000, len(ok)), 2),
                       "l_discount": np.round(rng.integers(0, 10, len(ok)) / 100, 2)})
    customer = pd.DataFrame({"c_custkey": np.arange(1, n_cust + 1, dtype="int64"),
                             "c_nationkey": (np.arange(n_cust) % 3).astype("int32")})
    nation = pd.DataFrame({"n_nationkey": np.arange(3, dtype="int32"), "n_name": ["A", "B", "C"]})
    for name, df in (("orders", orders), ("lineitem", li), ("customer", customer), ("nation", nation)):
        df.to_parquet(os.path.join(d, f"{name}.parquet"), index=False, coerce_timestamps="us")
    return d, orders, li, customer, nation


def test_hot_customer_base_is_exact(spark, skewed_dir):
    d, orders, li, customer, nation = skewed_dir
    got = rfm.customer_base(tables(spark, d)).toPandas().set_index("CustomerID").sort_index()
    tx = li.merge(orders, left_on="l_orderkey", right_on="o_orderkey")
    tx["rev"] = (tx.l_extendedprice * 100).round() * (100 - (tx.l_discount * 100).round()) / 10000
    snap = orders.o_orderdate.max().normalize()
    exp = tx.groupby("o_custkey").agg(last=("o_orderdate", "max"), Frequency=("o_orderkey", "nunique"),
                                      Monetary=("rev", "sum"), TotalItems=("l_quantity", "sum"),
                                      UniqueProducts=("l_partkey", "nunique"))
    exp["Recency"] = (snap - exp["last"].dt.normalize()).dt.days + 1
    assert list(got.index) == list(exp.index)
    assert (got.Frequency.values == exp.Frequency.values).all()
    assert (got.UniqueProducts.values == exp.UniqueProducts.values).all()
    assert (got.TotalItems.values == exp.TotalItems.values).all()
    assert (got.Recency.values == exp.Recency.values).all()
    assert np.allclose(got.Monetary.values, exp.Monetary.values, rtol=0, atol=1e-6)
    assert got.loc[1, "Frequency"] == 200


def test_pairs_shuffle_on_pair_key(spark, skewed_dir):
    d = skewed_dir[0]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rfm.customer_base(tables(spark, d))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(o_custkey" in plan and "l_partkey" in plan
    pair_ex = [ln for ln in plan.splitlines() if "Exchange hashpartitioning(o_custkey" in ln and "l_partkey" in ln]
    assert pair_ex, "distinct (customer, part) pairs must be exchanged on the pair"
