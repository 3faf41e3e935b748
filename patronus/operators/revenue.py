"""Revenue rollups, growth, shares and the linear-trend forecast (B13–B17,
W1–W6, U1, E11, E17).

Every rollup aggregates lineitem *before* joining: per order (for month and
country) or per part (for product names), so the join inputs are already
reduced and hash-partitioned on the join key.  Global windows only run on
aggregated sets (months, top-k rows).  The forecast is fitted with exact
sums (decimal revenue, integer month index) and one double division, so it
is independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronus.functions.numeric import money, pct, rnd
from patronus.operators.rfm import order_lines
from patronus.sources.tables import Tables


def monthly_revenue(t: Tables) -> DataFrame:
    """(Month 'yyyy-MM', Revenue double)."""
    o = t.orders().select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("Month"))
    return (o.join(order_lines(t), o.o_orderkey == F.col("l_orderkey"))
             .groupBy("Month").agg(F.sum("rev").cast("double").alias("Revenue")))


def monthly_growth(monthly: DataFrame) -> DataFrame:
    """Month-over-month growth %, 1 dp; first month 0, 0 when prev is 0."""
    w = Window.orderBy("Month")  # over months: an aggregated, bounded set
    prev = F.lag("Revenue").over(w)
    g = (F.when(prev.isNull() | (prev == 0), F.lit(0.0))
          .otherwise(rnd((F.col("Revenue") - prev) / prev * 100, 1)))
    return monthly.select("Month", "Revenue", g.alias("growth"))


def product_revenue(t: Tables) -> DataFrame:
    """Revenue per product name (names repeat across part keys)."""
    per_part = (t.lineitem().groupBy("l_partkey")
                 .agg(F.sum(money(F.col("l_extendedprice"), F.col("l_discount"))).alias("rev")))
    return (per_part.join(t.part(), per_part.l_partkey == F.col("p_partkey"))
                    .groupBy(F.col("p_name").alias("Product"))
                    .agg(F.sum("rev").cast("double").alias("Revenue")))


def top_k(df: DataFrame, key: str, n: int) -> DataFrame:
    """Top-n by Revenue desc, ties by key: a TakeOrderedAndProject."""
    return df.orderBy(F.col("Revenue").desc(), F.col(key)).limit(n)


def top_products(t: Tables, n: int = 10) -> DataFrame:
    return top_k(product_revenue(t), "Product", n)


def country_revenue(t: Tables) -> DataFrame:
    o = t.orders().select("o_orderkey", "o_custkey")
    per_cust = (o.join(order_lines(t), o.o_orderkey == F.col("l_orderkey"))
                 .groupBy("o_custkey").agg(F.sum("rev").alias("rev")))
    cust = (t.customer().join(F.broadcast(t.nation()), F.col("c_nationkey") == F.col("n_nationkey"))
             .select("c_custkey", "n_name"))
    return (per_cust.join(cust, per_cust.o_custkey == cust.c_custkey)
                    .groupBy(F.col("n_name").alias("Country"))
                    .agg(F.sum("rev").cast("double").alias("Revenue")))


def with_leader_pct(top: DataFrame) -> DataFrame:
    """Percent of the leader, 1 dp (top is a bounded top-k set)."""
    return top.withColumn("PctOfLeader", pct(F.col("Revenue"), F.max("Revenue").over(Window.partitionBy()), 1))


def top_countries(t: Tables, n: int = 10) -> DataFrame:
    return with_leader_pct(top_k(country_revenue(t), "Country", n))


def ellipsis(c: Column, width: int = 28) -> Column:
    """Text longer than ``width`` cut to ``width`` chars plus an ellipsis."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("…"))).otherwise(c)


def product_share(top: DataFrame) -> DataFrame:
    """W2, W3, W5, C18 over the top-k product list."""
    w_all = Window.partitionBy()
    total = F.sum(F.col("Revenue").cast("decimal(38,6)")).over(w_all).cast("double")
    return top.select(
        F.row_number().over(Window.orderBy(F.col("Revenue").desc(), F.col("Product"))).alias("Rank"),
        "Product", ellipsis(F.col("Product")).alias("Label"), "Revenue",
        pct(F.col("Revenue"), total, 2).alias("RevenueShare"),
        pct(F.col("Revenue"), F.max("Revenue").over(w_all), 1).alias("PctOfLeader"))


def product_totals(top: DataFrame) -> DataFrame:
    """Total of the listed products, the top product and its revenue."""
    return top.agg(rnd(F.sum(F.col("Revenue").cast("decimal(38,6)")).cast("double"), 2).alias("total_revenue"),
                   # highest revenue, ties to the smaller name
                   F.min_by("Product", F.struct((-F.col("Revenue")).alias("r"), F.col("Product").alias("p")))
                    .alias("top_product"),
                   rnd(F.max("Revenue"), 2).alias("top_product_revenue"))


def indexed(series: DataFrame, key: str = "Month", by: list[str] | None = None) -> DataFrame:
    """0-based position of each point in its series."""
    w = Window.partitionBy(*(by or [])).orderBy(key)
    return series.withColumn("idx", F.row_number().over(w) - 1)


def trend_fit(series: DataFrame, value: str = "Revenue", by: list[str] | None = None) -> DataFrame:
    """Least-squares line value ~ a + b·idx per series, from exact sums."""
    by = by or []
    x = F.col("idx").cast("decimal(20,0)")
    y = F.col(value).cast("decimal(38,6)")
    s = series.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"),
        F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"),
        F.max("Month").alias("last_month"))
    n = F.col("n").cast("decimal(20,0)")
    num = (n * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double")
    den = (n * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")
    slope = F.when(den != 0, num / den).otherwise(F.lit(0.0))
    return (s.withColumn("slope", slope)
             .withColumn("intercept", (F.col("sy").cast("double") - F.col("slope") * F.col("sx").cast("double"))
                         / F.col("n"))
             .select(*by, "n", "last_month", "slope", "intercept"))


def forecast(monthly: DataFrame, horizon: int = 6, by: list[str] | None = None) -> DataFrame:
    """Extrapolate the trend ``horizon`` months past the last month."""
    by = by or []
    fit = trend_fit(indexed(monthly, by=by), by=by)
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    return (fit.select(*by, "n", "last_month", "slope", "intercept", h)
               .select(*by,
                       F.date_format(F.add_months(F.to_date(F.concat(F.col("last_month"), F.lit("-01"))),
                                                  F.col("h")), "yyyy-MM").alias("Month"),
                       rnd(F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("h")), 2)
                       .alias("Revenue")))


def forecast_series(monthly: DataFrame, fc: DataFrame) -> DataFrame:
    """History + forecast, with the last actual point repeated as the
    first point of the forecast line (the chart's bridge)."""
    hist = monthly.select("Month", rnd(F.col("Revenue"), 2).alias("Revenue"), F.lit("historical").alias("kind"))
    last = (monthly.orderBy(F.col("Month").desc()).limit(1)
                   .select("Month", rnd(F.col("Revenue"), 2).alias("Revenue"), F.lit("forecast").alias("kind")))
    return hist.unionByName(last).unionByName(fc.select("Month", "Revenue", F.lit("forecast").alias("kind")))


def forecast_summary(monthly: DataFrame, fc: DataFrame) -> DataFrame:
    """Totals, mean history, growth % of mean forecast over mean history."""
    h = monthly.agg(F.sum(F.col("Revenue").cast("decimal(38,6)")).cast("double").alias("total_historical"),
                    F.count(F.lit(1)).alias("n_hist"))
    f = fc.agg(F.sum(F.col("Revenue").cast("decimal(38,6)")).cast("double").alias("total_forecast"),
               F.count(F.lit(1)).alias("n_fc"))
    x = h.crossJoin(f)
    mh = F.col("total_historical") / F.col("n_hist")
    mf = F.col("total_forecast") / F.col("n_fc")
    return x.select(rnd(F.col("total_historical"), 2).alias("total_historical"),
                    rnd(mh, 2).alias("avg_monthly"),
                    rnd(F.col("total_forecast"), 2).alias("total_forecast"),
                    rnd((mf - mh) / mh * 100, 1).alias("growth_pct"))
