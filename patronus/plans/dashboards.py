"""Dashboard queries (overview, segments, churn, customers, insights, export)."""

from __future__ import annotations

from patronus.operators import dashboards as D
from patronus.operators import rfm
from patronus.plans.registry import oracle, query
from patronus.functions.text import sql_fill
from patronus.plans.sqlbits import MEAN, R, with_base
from patronus.sources.customer_table import stored_profiles
from patronus.sources.tables import tables


def _rfm(spark, sf):
    return stored_profiles(tables(spark, sf))


def _r2(cols, types_double):
    return ", ".join(R(c, 2) + f" AS {c}" if c in types_double else c for c in cols)


DOUBLES = {"Monetary", "CLV", "ChurnScore", "AvgOrderValue"}


# E1
@query("segment_summary")
def q_segment_summary(spark, sf):
    return D.segment_summary(_rfm(spark, sf))


oracle("segment_summary", with_base(f"""
SELECT Segment, count(CustomerID) AS Count,
       {R(MEAN('Recency'), 2)} AS AvgRecency, {R(MEAN('Frequency'), 2)} AS AvgFrequency,
       {R(MEAN('Monetary'), 2)} AS AvgMonetary, {R(MEAN('CLV'), 2)} AS AvgCLV,
       {R(MEAN('ChurnScore'), 2)} AS AvgChurnScore
FROM rfm WHERE Segment IS NOT NULL GROUP BY Segment"""))


# E2
@query("rfm_heatmap")
def q_rfm_heatmap(spark, sf):
    return D.rfm_heatmap(_rfm(spark, sf))


oracle("rfm_heatmap", with_base(f"""
SELECT R_Score, F_Score, count(CustomerID) AS Count, {R(MEAN('Monetary'), 2)} AS AvgMonetary
FROM rfm GROUP BY R_Score, F_Score"""))


# C9/C10
_SCATTER = ["CustomerID", "Recency", "Frequency", "Monetary", "CLV", "Segment", "ChurnRisk", "RFM_Score"]


@query("segment_scatter_sample")
def q_segment_scatter(spark, sf):
    return D.segment_scatter(_rfm(spark, sf), 800)


oracle("segment_scatter_sample", with_base(f"""
SELECT {_r2(_SCATTER, DOUBLES)},
       least(greatest(CAST(Frequency AS DOUBLE), 1.5), 10.0) AS BubbleRadius
FROM rfm ORDER BY md5(CAST(CustomerID AS VARCHAR) || ':42'), CustomerID LIMIT 800"""))


# L1
@query("high_risk_customers")
def q_high_risk(spark, sf):
    return D.high_risk_customers(_rfm(spark, sf), 20)


oracle("high_risk_customers", with_base(f"""
SELECT {_r2(D.HIGH_RISK_COLUMNS, DOUBLES)}
FROM rfm WHERE ChurnRisk = 'High' ORDER BY Monetary DESC, CustomerID LIMIT 20"""))


# E4/W4
@query("churn_distribution")
def q_churn_distribution(spark, sf):
    return D.churn_distribution(_rfm(spark, sf))


oracle("churn_distribution", with_base(f"""
SELECT ChurnRisk, Count, {R('100.0 * Count / sum(Count) OVER ()', 1)} AS Share
FROM (SELECT ChurnRisk, count(*) AS Count FROM rfm WHERE ChurnRisk IS NOT NULL GROUP BY ChurnRisk)"""))


# E5
@query("churn_by_segment")
def q_churn_by_segment(spark, sf):
    return D.churn_by_segment(_rfm(spark, sf))


oracle("churn_by_segment", with_base("""
SELECT Segment, count(*) FILTER (WHERE ChurnRisk = 'Low') AS Low,
       count(*) FILTER (WHERE ChurnRisk = 'Medium') AS Medium,
       count(*) FILTER (WHERE ChurnRisk = 'High') AS High
FROM rfm WHERE Segment IS NOT NULL AND ChurnRisk IS NOT NULL GROUP BY Segment"""))


# E6
@query("recency_by_risk")
def q_recency_by_risk(spark, sf):
    return D.recency_by_risk(_rfm(spark, sf))


oracle("recency_by_risk", with_base(f"""
SELECT ChurnRisk, {R(MEAN('Recency'), 1)} AS AvgRecency
FROM rfm WHERE ChurnRisk IS NOT NULL GROUP BY ChurnRisk"""))


# E7/W3
@query("churn_by_country")
def q_churn_by_country(spark, sf):
    return D.churn_by_country(_rfm(spark, sf), 8)


oracle("churn_by_country", with_base(f"""
SELECT Country, Count, {R('100.0 * Count / max(Count) OVER ()', 1)} AS PctOfLeader
FROM (SELECT Country, count(*) AS Count FROM rfm
      WHERE ChurnRisk = 'High' AND Country IS NOT NULL GROUP BY Country
      ORDER BY Count DESC, Country LIMIT 8)"""))


# E8
@query("revenue_at_risk")
def q_revenue_at_risk(spark, sf):
    return D.revenue_at_risk(_rfm(spark, sf))


oracle("revenue_at_risk", with_base(f"""
SELECT {R("coalesce(CAST(sum(CAST(Monetary AS DECIMAL(38,6))) FILTER (WHERE ChurnRisk = 'High') AS DOUBLE), 0.0)", 2)}
       AS revenue_at_risk FROM rfm"""))


# E9/C14
@query("overview_kpis")
def q_overview_kpis(spark, sf):
    return D.overview_kpis(_rfm(spark, sf))


oracle("overview_kpis", with_base(f"""
SELECT total_customers, {R('total_revenue', 2)} AS total_revenue, {R('avg_clv', 2)} AS avg_clv,
       {R('avg_order_value', 2)} AS avg_order_value, high_churn_count, champions_count,
       {R('100.0 * high_churn_count / total_customers', 1)} AS churn_rate,
       {R('100.0 * (total_customers - high_churn_count) / total_customers', 1)} AS retention_rate
FROM (SELECT count(*) AS total_customers,
             CAST(sum(CAST(Monetary AS DECIMAL(38,6))) AS DOUBLE) AS total_revenue,
             {MEAN('CLV')} AS avg_clv, {MEAN('AvgOrderValue')} AS avg_order_value,
             count(*) FILTER (WHERE ChurnRisk = 'High') AS high_churn_count,
             count(*) FILTER (WHERE Segment = 'Champions') AS champions_count
      FROM rfm)"""))


# B16
@query("stats_summary")
def q_stats_summary(spark, sf):
    return D.stats_summary(_rfm(spark, sf))


oracle("stats_summary", with_base(f"""
SELECT count(*) AS total_customers, {R('CAST(sum(CAST(Monetary AS DECIMAL(38,6))) AS DOUBLE)', 2)} AS total_revenue,
       {R(MEAN('CLV'), 2)} AS avg_clv, {R(MEAN('AvgOrderValue'), 2)} AS avg_order_value,
       count(*) FILTER (WHERE ChurnRisk = 'High') AS high_churn_count,
       count(*) FILTER (WHERE Segment = 'Champions') AS champions_count
FROM rfm"""))


# E10
@query("count_maps")
def q_count_maps(spark, sf):
    return D.count_maps(_rfm(spark, sf))


oracle("count_maps", with_base("""
SELECT 'segment' AS kind, Segment AS key, count(*) AS Count FROM rfm WHERE Segment IS NOT NULL GROUP BY Segment
UNION ALL
SELECT 'churn' AS kind, ChurnRisk AS key, count(*) AS Count FROM rfm WHERE ChurnRisk IS NOT NULL GROUP BY ChurnRisk"""))


# E12/E13
_INSIGHT_CTE = """
im AS (
  SELECT total_customers, high_churn_count, champions_count,
         %s AS churn_rate, %s AS revenue_at_risk, %s AS avg_clv_champions,
         %s AS champions_revenue_share, top_segment, top_segment_count
  FROM (SELECT count(*) AS total_customers,
               count(*) FILTER (WHERE ChurnRisk = 'High') AS high_churn_count,
               count(*) FILTER (WHERE Segment = 'Champions') AS champions_count,
               CAST(sum(CAST(Monetary AS DECIMAL(38,6))) AS DOUBLE) AS total_revenue,
               coalesce(CAST(sum(CAST(Monetary AS DECIMAL(38,6))) FILTER (WHERE ChurnRisk = 'High') AS DOUBLE), 0.0) AS risk_revenue,
               CAST(sum(CAST(Monetary AS DECIMAL(38,6))) FILTER (WHERE Segment = 'Champions') AS DOUBLE) AS champ_revenue,
               CAST(sum(CAST(CLV AS DECIMAL(38,6))) FILTER (WHERE Segment = 'Champions') AS DOUBLE)
                 / count(CLV) FILTER (WHERE Segment = 'Champions') AS champ_clv
        FROM rfm)
  CROSS JOIN (SELECT Segment AS top_segment, count(*) AS top_segment_count FROM rfm
              WHERE Segment IS NOT NULL GROUP BY Segment ORDER BY count(*) DESC, Segment LIMIT 1))
""" % (R('100.0 * high_churn_count / total_customers', 1), R('risk_revenue', 0),
       R('champ_clv', 2), R('100.0 * champ_revenue / total_revenue', 1))


@query("insight_metrics")
def q_insight_metrics(spark, sf):
    return D.insight_metrics(_rfm(spark, sf))


oracle("insight_metrics", with_base("SELECT * FROM im", _INSIGHT_CTE))


# E14/C17
@query("insight_rows")
def q_insight_rows(spark, sf):
    return D.insight_rows(D.insight_metrics(_rfm(spark, sf)))


_INSIGHT_SQL_VALUES = {
    "churn_rate": "CAST(churn_rate AS VARCHAR)",
    "high_churn_count": "format('{:,}', high_churn_count)",
    "revenue_at_risk": "format('{:,.0f}', revenue_at_risk)",
    "champions_revenue_share": "CAST(champions_revenue_share AS VARCHAR)",
    "champions_count": "format('{:,}', champions_count)",
    "avg_clv_champions": "format('{:,.2f}', avg_clv_champions)",
    "top_segment": "top_segment",
    "top_segment_count": "format('{:,}', top_segment_count)",
}
oracle("insight_rows", with_base("\nUNION ALL\n".join(
    f"SELECT {i + 1} AS idx, '{t}' AS type, '{icon}' AS icon, "
    f"{sql_fill(title, _INSIGHT_SQL_VALUES)} AS title, {sql_fill(body, _INSIGHT_SQL_VALUES)} AS body, "
    f"'{action}' AS action, '{page}' AS page FROM im"
    for i, (t, icon, title, body, action, page) in enumerate(D.INSIGHT_CARDS)), _INSIGHT_CTE))


# C2
@query("customers_filtered")
def q_customers_filtered(spark, sf):
    return D.export_projection(D.filter_customers(_rfm(spark, sf), segment="Champions", churn="Low"))


oracle("customers_filtered", with_base(f"""
SELECT {_r2(D.EXPORT_COLUMNS, DOUBLES)} FROM rfm WHERE Segment = 'Champions' AND ChurnRisk = 'Low'"""))


# C3/C4 — a regular expression found anywhere in the id text
_SEARCH = "1.3"


@query("customers_search")
def q_customers_search(spark, sf):
    return D.export_projection(D.filter_customers(_rfm(spark, sf), search=f"  {_SEARCH} "))


oracle("customers_search", with_base(f"""
SELECT {_r2(D.EXPORT_COLUMNS, DOUBLES)} FROM rfm
WHERE regexp_matches(CAST(CustomerID AS VARCHAR), '{_SEARCH}')"""))


# C8/L3
_PAGE = dict(page=2, per_page=25, search="", segment="", churn="High", sort="Recency", direction="asc")


@query("customers_page")
def q_customers_page(spark, sf):
    return D.customers_page(_rfm(spark, sf), **_PAGE)


oracle("customers_page", with_base(f"""
SELECT {_r2(D.EXPORT_COLUMNS, DOUBLES)} FROM rfm WHERE ChurnRisk = 'High'
ORDER BY Recency ASC, CustomerID ASC LIMIT 25 OFFSET 25"""))


@query("customers_page_default")
def q_customers_page_default(spark, sf):
    # unknown sort column falls back to Monetary desc
    return D.customers_page(_rfm(spark, sf), page=1, per_page=20, sort="NoSuchColumn")


oracle("customers_page_default", with_base(f"""
SELECT {_r2(D.EXPORT_COLUMNS, DOUBLES)} FROM rfm ORDER BY Monetary DESC, CustomerID LIMIT 20"""))


@query("customers_page_info")
def q_customers_page_info(spark, sf):
    p = {k: v for k, v in _PAGE.items() if k not in ("sort", "direction")}
    return D.customers_page_info(_rfm(spark, sf), **p)


oracle("customers_page_info", with_base("""
SELECT total, 2 AS page, 25 AS per_page, CAST(greatest(1, ceil(total / 25)) AS BIGINT) AS pages
FROM (SELECT count(*) AS total FROM rfm WHERE ChurnRisk = 'High')"""))


# C5
_DETAIL_ID = 1


@query("customer_detail")
def q_customer_detail(spark, sf):
    return D.customer_detail(_rfm(spark, sf), _DETAIL_ID)


_ALL = ["CustomerID", "Recency", "Frequency", "Monetary", "AvgOrderValue", "TotalItems",
        "UniqueProducts", "Country", "R_Score", "F_Score", "M_Score", "RFM_Score", "CLV",
        "ChurnScore", "ChurnRisk", "Segment", "Recommendation"]
oracle("customer_detail", with_base(f"""
SELECT {_r2(_ALL, DOUBLES)} FROM rfm WHERE CustomerID = {_DETAIL_ID}"""))


# A10 pre-sink projection
@query("export_customers")
def q_export(spark, sf):
    return D.export_projection(_rfm(spark, sf))


oracle("export_customers", with_base(f"SELECT {_r2(D.EXPORT_COLUMNS, DOUBLES)} FROM rfm"))


# A1 + A10: the customer table written by the CSV sink into the shared
# checkpoint folder and scanned back with its declared schema
@query("scan_rfm_csv")
def q_scan_csv(spark, sf):
    from patronus.session import scratch_path
    from patronus.sources.files import read_export_csv
    from patronus.sources.sinks import export_customers_csv
    import uuid
    path = export_customers_csv(_rfm(spark, sf), scratch_path(spark, f"export-{uuid.uuid4().hex}"))
    return read_export_csv(spark, path)


oracle("scan_rfm_csv", with_base(f"SELECT {_r2(D.EXPORT_COLUMNS, DOUBLES)} FROM rfm"))


# C6
@query("dedupe_rows")
def q_dedupe(spark, sf):
    # two columns only, so that there are equal rows; both counts read the same table, materialised once
    few = rfm.customer_base(tables(spark, sf)).select("Frequency", "Country")
    return D.dedupe_report(few.checkpoint(eager=True))


oracle("dedupe_rows", with_base("""
SELECT rows_before, rows_after, rows_before - rows_after AS removed
FROM (SELECT count(*) AS rows_before FROM base)
CROSS JOIN (SELECT count(*) AS rows_after FROM (SELECT DISTINCT Frequency, Country FROM base))"""))
