"""Customer derivation queries and rule scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronus.functions.numeric import rnd
from patronus.operators import rfm
from patronus.plans.registry import oracle, query
from patronus.plans.sqlbits import R, rec_case, risk_case, seg_case, with_base
from patronus.sources.tables import tables


@query("rfm_base")
def q_rfm_base(spark, sf):
    return rfm.customer_base(tables(spark, sf))


oracle("rfm_base", with_base(
    "SELECT CustomerID, Recency, Frequency, Monetary, AvgOrderValue, TotalItems, "
    "UniqueProducts, Country FROM base"))


@query("rfm_quartiles")
def q_rfm_quartiles(spark, sf):
    st = rfm.rfm_stats(rfm.customer_base(tables(spark, sf)))
    return st.select("n", "rmax", "fmax",
                     *[rnd(F.col(c), 4).alias(c) for c in
                       ["r1", "r2", "r3", "f1", "f2", "f3", "m1", "m2", "m3"]])


oracle("rfm_quartiles", with_base(
    "SELECT n, rmax, fmax, " + ", ".join(f"{R(c, 4)} AS {c}" for c in
                                          ["r1", "r2", "r3", "f1", "f2", "f3", "m1", "m2", "m3"])
    + " FROM st"))


@query("rfm_scores")
def q_rfm_scores(spark, sf):
    return rfm.customer_profiles(tables(spark, sf)).select(
        "CustomerID", "R_Score", "F_Score", "M_Score", "RFM_Score")


oracle("rfm_scores", with_base(
    "SELECT CustomerID, R_Score, F_Score, M_Score, RFM_Score FROM rfm"))


@query("rfm_segments")
def q_rfm_segments(spark, sf):
    return rfm.customer_profiles(tables(spark, sf)).select("CustomerID", "RFM_Score", "Segment")


oracle("rfm_segments", with_base("SELECT CustomerID, RFM_Score, Segment FROM rfm"))


@query("recommendations")
def q_recommendations(spark, sf):
    return rfm.customer_profiles(tables(spark, sf)).select("CustomerID", "Segment", "Recommendation")


oracle("recommendations", with_base("SELECT CustomerID, Segment, Recommendation FROM rfm"))


@query("churn_risk_rule")
def q_churn_risk(spark, sf):
    return rfm.recency_risk(tables(spark, sf))


oracle("churn_risk_rule", with_base("SELECT CustomerID, Recency, ChurnRisk FROM rfm"))


@query("churn_score")
def q_churn_score(spark, sf):
    return rfm.customer_profiles(tables(spark, sf)).select(
        "CustomerID", rnd(F.col("ChurnScore"), 4).alias("ChurnScore"))


oracle("churn_score", with_base(f"SELECT CustomerID, {R('ChurnScore', 4)} AS ChurnScore FROM rfm"))


@query("customer_clv")
def q_customer_clv(spark, sf):
    return rfm.customer_profiles(tables(spark, sf)).select(
        "CustomerID", rnd(F.col("CLV"), 2).alias("CLV"))


oracle("customer_clv", with_base(f"SELECT CustomerID, {R('CLV', 2)} AS CLV FROM rfm"))


def _requests(spark, sf):
    """Score requests derived from the data: every customer's own R, F, M."""
    base = rfm.customer_base(tables(spark, sf)).checkpoint(eager=True)
    return base, base.select("CustomerID",
                             F.col("Recency").alias("recency"),
                             F.col("Frequency").alias("frequency"),
                             F.col("Monetary").alias("monetary"))


@query("score_defaults")
def q_score_defaults(spark, sf):
    _, req = _requests(spark, sf)
    # fields missing by a rule on the id, so that every default is used
    req = req.select("CustomerID", *[F.when(F.col("CustomerID") % m != 0, F.col(c)).alias(c)
                                     for c, m in (("recency", 5), ("frequency", 7), ("monetary", 11))])
    return rfm.score_inputs(req).select(
        "CustomerID", "recency", "frequency", "monetary",
        rnd(F.col("avg_order"), 2).alias("avg_order"), "total_items", "unique_products")


oracle("score_defaults", with_base(f"""
SELECT CustomerID, recency, frequency, monetary, {R('monetary / greatest(frequency, 1.0)', 2)} AS avg_order,
       CAST(trunc(frequency * 15) AS INTEGER) AS total_items,
       least(CAST(trunc(frequency * 8) AS INTEGER), 200) AS unique_products
FROM (SELECT CustomerID, CASE WHEN CustomerID % 5 <> 0 THEN CAST(Recency AS DOUBLE) ELSE 30.0 END AS recency,
             CASE WHEN CustomerID % 7 <> 0 THEN CAST(Frequency AS DOUBLE) ELSE 5.0 END AS frequency,
             CASE WHEN CustomerID % 11 <> 0 THEN CAST(Monetary AS DOUBLE) ELSE 500.0 END AS monetary FROM base)"""))


@query("score_customers_rule")
def q_score_rule(spark, sf):
    base, req = _requests(spark, sf)
    return rfm.score_rule(req, rfm.rfm_stats(base))


oracle("score_customers_rule", with_base(f"""
SELECT CustomerID, {R('clv', 2)} AS clv, {risk_case('recency')} AS churn_risk,
       {R('p * 100', 1)} AS churn_score, {R('p', 3)} AS churn_probability,
       {seg_case('rs + fs + ms')} AS segment, rs + fs + ms AS rfm_score,
       rs AS r_score, fs AS f_score, ms AS m_score,
       {rec_case(seg_case('rs + fs + ms'))} AS recommendation,
       {R('monetary / greatest(frequency, 1.0)', 2)} AS avg_order_value,
       'rule' AS model_used
FROM (
  SELECT CustomerID, recency, frequency, monetary,
         greatest(0.0, monetary * (1 + frequency / fmax) * (1 - recency / rmax)) AS clv,
         least(100.0, recency / rmax * 100) / 100 AS p,
         CASE WHEN recency <= r1 THEN 4 WHEN recency <= r2 THEN 3 WHEN recency <= r3 THEN 2 ELSE 1 END AS rs,
         CASE WHEN frequency >= f3 THEN 4 WHEN frequency >= f2 THEN 3 WHEN frequency >= f1 THEN 2 ELSE 1 END AS fs,
         CASE WHEN monetary >= m3 THEN 4 WHEN monetary >= m2 THEN 3 WHEN monetary >= m1 THEN 2 ELSE 1 END AS ms
  FROM (SELECT CustomerID, CAST(Recency AS DOUBLE) AS recency, CAST(Frequency AS DOUBLE) AS frequency,
               Monetary AS monetary FROM base) CROSS JOIN st)"""))
