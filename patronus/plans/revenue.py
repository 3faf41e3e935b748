"""Revenue queries: monthly rollup and growth, products, countries, forecast."""

from __future__ import annotations

import uuid

from patronus.operators import revenue as V
from patronus.plans.registry import oracle, query
from patronus.plans.sqlbits import R
from patronus.session import scratch_path
from patronus.sources.files import read_countries_csv, read_monthly_csv, read_products_csv
from patronus.sources.sinks import write_csv
from patronus.sources.tables import tables

HORIZON = 6
TOP_N = 10

MONTHLY_CTE = """
monthly AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS Month,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS Revenue
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"""

PRODUCT_CTE = """
prod AS (
  SELECT p_name AS Product,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS Revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name),
top AS (SELECT * FROM prod ORDER BY Revenue DESC, Product LIMIT %d)""" % TOP_N

FORECAST_CTE = MONTHLY_CTE + """,
ix AS (SELECT Month, Revenue, row_number() OVER (ORDER BY Month) - 1 AS idx FROM monthly),
s AS (SELECT CAST(count(*) AS DECIMAL(20,0)) AS n, sum(CAST(idx AS DECIMAL(20,0))) AS sx,
             sum(CAST(idx AS DECIMAL(20,0)) * CAST(idx AS DECIMAL(20,0))) AS sxx,
             sum(CAST(Revenue AS DECIMAL(38,6))) AS sy,
             sum(CAST(idx AS DECIMAL(20,0)) * CAST(Revenue AS DECIMAL(38,6))) AS sxy,
             max(Month) AS last_month FROM ix),
fit AS (SELECT n, last_month, slope,
               (CAST(sy AS DOUBLE) - slope * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) AS intercept
        FROM (SELECT *, CASE WHEN CAST(n * sxx - sx * sx AS DOUBLE) <> 0
                             THEN CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE)
                             ELSE 0.0 END AS slope FROM s)),
fc AS (SELECT strftime(CAST(last_month || '-01' AS DATE) + to_months(CAST(h AS INTEGER)), '%Y-%m') AS Month,
              """ + R("intercept + slope * (CAST(n AS DOUBLE) - 1 + h)", 2) + """ AS Revenue
       FROM fit CROSS JOIN range(1, """ + str(HORIZON + 1) + """) AS t(h))"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


@query("monthly_revenue")
def q_monthly(spark, sf):
    return V.monthly_revenue(tables(spark, sf))


oracle("monthly_revenue", _with(MONTHLY_CTE, "SELECT Month, Revenue FROM monthly"))


@query("monthly_growth")
def q_monthly_growth(spark, sf):
    return V.monthly_growth(V.monthly_revenue(tables(spark, sf)))


oracle("monthly_growth", _with(MONTHLY_CTE, f"""
SELECT Month, Revenue,
       CASE WHEN prev IS NULL OR prev = 0 THEN 0.0 ELSE {R('(Revenue - prev) / prev * 100', 1)} END AS growth
FROM (SELECT Month, Revenue, lag(Revenue) OVER (ORDER BY Month) AS prev FROM monthly)"""))


@query("top_products")
def q_top_products(spark, sf):
    return V.top_products(tables(spark, sf), TOP_N)


oracle("top_products", _with(PRODUCT_CTE, "SELECT Product, Revenue FROM top"))


@query("product_share")
def q_product_share(spark, sf):
    return V.product_share(V.top_products(tables(spark, sf), TOP_N))


oracle("product_share", _with(PRODUCT_CTE, f"""
SELECT row_number() OVER (ORDER BY Revenue DESC, Product) AS Rank, Product,
       CASE WHEN length(Product) > 28 THEN substring(Product, 1, 28) || '…' ELSE Product END AS Label,
       Revenue,
       {R('100.0 * Revenue / CAST(sum(CAST(Revenue AS DECIMAL(38,6))) OVER () AS DOUBLE)', 2)} AS RevenueShare,
       {R('100.0 * Revenue / max(Revenue) OVER ()', 1)} AS PctOfLeader
FROM top"""))


@query("product_totals")
def q_product_totals(spark, sf):
    return V.product_totals(V.top_products(tables(spark, sf), TOP_N))


oracle("product_totals", _with(PRODUCT_CTE, f"""
SELECT {R('CAST(sum(CAST(Revenue AS DECIMAL(38,6))) AS DOUBLE)', 2)} AS total_revenue,
       arg_min(Product, struct_pack(r := -Revenue, p := Product)) AS top_product,
       {R('max(Revenue)', 2)} AS top_product_revenue
FROM top"""))


@query("top_countries")
def q_top_countries(spark, sf):
    return V.top_countries(tables(spark, sf), TOP_N)


oracle("top_countries", f"""
WITH cr AS (
  SELECT n_name AS Country,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS Revenue
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name),
top AS (SELECT * FROM cr ORDER BY Revenue DESC, Country LIMIT {TOP_N})
SELECT Country, Revenue, {R('100.0 * Revenue / max(Revenue) OVER ()', 1)} AS PctOfLeader FROM top""")


@query("revenue_forecast")
def q_forecast(spark, sf):
    return V.forecast(V.monthly_revenue(tables(spark, sf)), HORIZON)


oracle("revenue_forecast", _with(FORECAST_CTE, "SELECT Month, Revenue FROM fc"))


@query("forecast_series")
def q_forecast_series(spark, sf):
    m = V.monthly_revenue(tables(spark, sf))
    return V.forecast_series(m, V.forecast(m, HORIZON))


oracle("forecast_series", _with(FORECAST_CTE, f"""
SELECT Month, {R('Revenue', 2)} AS Revenue, 'historical' AS kind FROM monthly
UNION ALL
SELECT * FROM (SELECT Month, {R('Revenue', 2)} AS Revenue, 'forecast' AS kind FROM monthly ORDER BY Month DESC LIMIT 1)
UNION ALL
SELECT Month, Revenue, 'forecast' AS kind FROM fc"""))


@query("forecast_summary")
def q_forecast_summary(spark, sf):
    m = V.monthly_revenue(tables(spark, sf))
    return V.forecast_summary(m, V.forecast(m, HORIZON))


oracle("forecast_summary", _with(FORECAST_CTE, f"""
SELECT {R('th', 2)} AS total_historical, {R('th / nh', 2)} AS avg_monthly, {R('tf', 2)} AS total_forecast,
       {R('(tf / nf - th / nh) / (th / nh) * 100', 1)} AS growth_pct
FROM (SELECT CAST(sum(CAST(Revenue AS DECIMAL(38,6))) AS DOUBLE) AS th, count(*) AS nh FROM monthly)
CROSS JOIN (SELECT CAST(sum(CAST(Revenue AS DECIMAL(38,6))) AS DOUBLE) AS tf, count(*) AS nf FROM fc)"""))


# A2, A3, A4: the revenue tables written as CSV and scanned with their declared schemas
def _scanned(spark, df, read):
    return read(spark, write_csv(df, scratch_path(spark, f"csv-{uuid.uuid4().hex}")))


@query("scan_monthly_csv")
def q_scan_monthly(spark, sf):
    return _scanned(spark, V.monthly_revenue(tables(spark, sf)), read_monthly_csv)


oracle("scan_monthly_csv", _with(MONTHLY_CTE, "SELECT Month, Revenue FROM monthly"))


@query("scan_products_csv")
def q_scan_products(spark, sf):
    return _scanned(spark, V.product_revenue(tables(spark, sf)), read_products_csv)


oracle("scan_products_csv", _with(PRODUCT_CTE, "SELECT Product, Revenue FROM prod"))


@query("scan_countries_csv")
def q_scan_countries(spark, sf):
    return _scanned(spark, V.country_revenue(tables(spark, sf)), read_countries_csv)


oracle("scan_countries_csv", """
SELECT n_name AS Country,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS Revenue
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
     JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name""")
