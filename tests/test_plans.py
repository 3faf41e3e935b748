"""Physical-plan checks: pruning and pushdown reach the parquet scan,
fixed-size dimensions are broadcast, top-k is a TakeOrderedAndProject,
the customer aggregation pre-aggregates lineitem before the join."""

import pytest

from patronus.operators import dashboards as D
from patronus.operators import revenue as V
from patronus.operators import rfm
from patronus.sources.tables import tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark, sf_small):
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # show the static plan
    yield tables(spark, sf_small)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scan_prunes_columns(t):
    p = _plan(rfm.customer_base(t))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity" in p
    assert "l_tax" not in p and "l_shipdate" not in p and "c_acctbal" not in p


def test_lineitem_is_shuffled_once(spark, t):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(rfm.customer_base(t))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("l_extendedprice") and len([x for x in p.splitlines() if "FileScan" in x and "l_orderkey" in x]) == 1
    assert len([x for x in p.splitlines() if "Exchange hashpartitioning(l_orderkey" in x]) == 1


def test_nation_is_broadcast(spark, t):
    """The 25-row dimension is broadcast by its hint, whatever the threshold."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(rfm.customer_base(t))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in p and "c_nationkey" in p


def test_partial_aggregation_before_shuffle(t):
    p = _plan(rfm.order_lines(t))
    assert "HashAggregate" in p and "partial_sum" in p


def test_top_k_is_take_ordered(t):
    p = _plan(V.top_products(t, 10))
    assert "TakeOrderedAndProject" in p


def test_keyed_sample_is_take_ordered(spark, t):
    base = rfm.customer_base(t)
    p = _plan(D.keyed_sample(base, 50))
    assert "TakeOrderedAndProject" in p


def test_statistics_row_is_broadcast(spark, sf_small):
    base = rfm.customer_base(tables(spark, sf_small))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(rfm.score(base))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastNestedLoopJoin" in p
    assert "CartesianProduct" not in p


def test_point_lookup_is_pushed_into_the_stored_table(spark, t):
    from patronus.sources.customer_table import stored_profiles
    stored = stored_profiles(t)
    p = _plan(D.customer_detail(stored, 7))
    assert "PushedFilters: [IsNotNull(CustomerID), EqualTo(CustomerID,7)]" in p and "Exchange" not in p
    assert stored_profiles(t).inputFiles() == stored.inputFiles()      # written once
    assert stored.exceptAll(rfm.customer_profiles(t)).count() == 0 and stored.count() == rfm.customer_profiles(t).count()


def test_churn_risk_reads_order_keys_only(t):
    p = _plan(rfm.recency_risk(t))
    assert "ReadSchema: struct<l_orderkey:bigint>" in p
    assert "l_extendedprice" not in p and "l_partkey" not in p


def test_stored_table_follows_its_sources(spark, sf_small, tmp_path):
    """New source files give a new table; a source may be a folder of files."""
    import shutil
    from patronus.sources.customer_table import SOURCES, content_key, stored_profiles
    for n in SOURCES:
        shutil.copyfile(f"{sf_small}/{n}.parquet", tmp_path / f"{n}.parquet")
    t = tables(spark, str(tmp_path))
    key, first = content_key(t), stored_profiles(t).count()
    few = spark.read.parquet(f"{sf_small}/orders.parquet").where("o_custkey % 2 = 0")
    (tmp_path / "orders.parquet").unlink()
    few.write.parquet(str(tmp_path / "orders.parquet"))
    assert content_key(t) != key
    half = stored_profiles(t)
    assert 0 < half.count() < first and half.where("CustomerID % 2 = 1").count() == 0
