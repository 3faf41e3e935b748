"""Differential checks: registered Spark queries vs their DuckDB oracle
(sf0.001).  A representative subset runs by default; PATRONUS_ALL_ORACLES=1
runs every query that has an oracle."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from patronus.sources.tables import TABLES

SUBSET = ["rfm_base", "rfm_quartiles", "score_customers_rule", "segment_summary", "insight_rows",
          "customers_page", "monthly_growth", "product_share", "revenue_forecast", "customer_clusters",
          "stratified_split", "onehot_country", "roc_auc", "roc_points", "model_explanation"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("PATRONUS_ALL_ORACLES") else SUBSET


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    return v.item() if hasattr(v, "item") else v


def _rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, con, name):
    s = E.queries()[name](spark, sf_small).toPandas()
    d = con.execute(E.oracle_sql()[name]).df()
    sc, sr = _rows(s)
    dc, dr = _rows(d)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
