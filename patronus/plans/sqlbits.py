"""Shared DuckDB SQL fragments for the oracle strings.

The oracle is the independent statement of each query's meaning in plain
SQL over the same parquet tables.  These helpers keep the number rules
(decimal rounding, exact means, keyed draws) written once.
"""

from __future__ import annotations

from patronus import config as C


def R(x: str, s: int) -> str:
    """Half-to-even rounding through DECIMAL(38,6), as ``functions.numeric.rnd``."""
    return f"CAST(round_even(CAST(({x}) AS DECIMAL(38,6)), {s}) AS DOUBLE)"


def MEAN(x: str) -> str:
    return f"(CAST(sum(CAST(({x}) AS DECIMAL(38,6))) AS DOUBLE) / count({x}))"


def seg_case(col: str) -> str:
    parts = " ".join(f"WHEN {col} >= {lo} THEN '{name}'" for lo, name in C.SEGMENT_RULES)
    return f"CASE {parts} ELSE '{C.SEGMENT_ELSE}' END"


def rec_case(col: str) -> str:
    parts = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in C.RECOMMENDATIONS.items())
    return f"CASE {parts} END"


def risk_case(col: str) -> str:
    return (f"CASE WHEN {col} > {C.CHURN_HIGH_DAYS} THEN 'High' "
            f"WHEN {col} > {C.CHURN_MEDIUM_DAYS} THEN 'Medium' ELSE 'Low' END")


# Customer base, statistics and scores: the CTE chain most oracles start from.
BASE_CTES = f"""
snap AS (SELECT CAST(max(o_orderdate) AS DATE) AS snap_date FROM orders),
tx AS (
  SELECT o_custkey AS CustomerID, o_orderkey, CAST(o_orderdate AS DATE) AS od, l_partkey, l_quantity,
         CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS rev
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
agg AS (
  SELECT CustomerID,
         CAST(date_diff('day', max(od), (SELECT snap_date FROM snap)) + 1 AS INTEGER) AS Recency,
         CAST(count(DISTINCT o_orderkey) AS BIGINT) AS Frequency,
         CAST(sum(rev) AS DOUBLE) AS Monetary,
         CAST(sum(l_quantity) AS BIGINT) AS TotalItems,
         CAST(count(DISTINCT l_partkey) AS BIGINT) AS UniqueProducts
  FROM tx GROUP BY CustomerID),
base AS (
  SELECT a.CustomerID, a.Recency, a.Frequency, a.Monetary,
         a.Monetary / greatest(a.Frequency, 1) AS AvgOrderValue,
         a.TotalItems, a.UniqueProducts, n_name AS Country
  FROM agg a LEFT JOIN customer ON c_custkey = a.CustomerID
             LEFT JOIN nation ON c_nationkey = n_nationkey),
st AS (
  SELECT count(*) AS n, max(Recency) AS rmax, max(Frequency) AS fmax,
         quantile_cont(Recency, 0.25) AS r1, quantile_cont(Recency, 0.5) AS r2,
         quantile_cont(Recency, 0.75) AS r3,
         quantile_cont(Frequency, 0.25) AS f1, quantile_cont(Frequency, 0.5) AS f2,
         quantile_cont(Frequency, 0.75) AS f3,
         quantile_cont(Monetary, 0.25) AS m1, quantile_cont(Monetary, 0.5) AS m2,
         quantile_cont(Monetary, 0.75) AS m3
  FROM base),
sc AS (
  SELECT b.*,
         CASE WHEN Recency <= r1 THEN 4 WHEN Recency <= r2 THEN 3 WHEN Recency <= r3 THEN 2 ELSE 1 END AS R_Score,
         CASE WHEN Frequency >= f3 THEN 4 WHEN Frequency >= f2 THEN 3 WHEN Frequency >= f1 THEN 2 ELSE 1 END AS F_Score,
         CASE WHEN Monetary >= m3 THEN 4 WHEN Monetary >= m2 THEN 3 WHEN Monetary >= m1 THEN 2 ELSE 1 END AS M_Score,
         greatest(0.0, Monetary * (1 + Frequency / fmax) * (1 - Recency / rmax)) AS CLV,
         least(100.0, Recency / rmax * 100) AS ChurnScore,
         {risk_case('Recency')} AS ChurnRisk
  FROM base b CROSS JOIN st),
rfm AS (
  SELECT *, R_Score + F_Score + M_Score AS RFM_Score,
         {seg_case('R_Score + F_Score + M_Score')} AS Segment,
         {rec_case(seg_case('R_Score + F_Score + M_Score'))} AS Recommendation
  FROM sc)
"""


def with_base(body: str, extra_ctes: str = "") -> str:
    ctes = BASE_CTES.strip()
    if extra_ctes:
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH RECURSIVE {ctes}\n{body}"
