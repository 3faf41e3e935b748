"""Dashboard aggregates, filters, top-k lists and pages over the scored
customer table (SURVEY §2.3, §2.5, §2.7).

All functions take the scored customer frame and return a frame; nothing
is collected.  Global windows only ever run over already-aggregated sets of
bounded size (risk classes, top-k rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronus import config as C
from patronus.functions.keyed import keyed_hex
from patronus.functions.numeric import exact_mean, pct, rnd
from patronus.functions.text import fill

EXPORT_COLUMNS = ["CustomerID", "Recency", "Frequency", "Monetary", "CLV", "ChurnRisk",
                  "ChurnScore", "Segment", "RFM_Score", "Country", "AvgOrderValue",
                  "UniqueProducts", "Recommendation"]
HIGH_RISK_COLUMNS = ["CustomerID", "Recency", "Frequency", "Monetary", "CLV", "ChurnScore",
                     "Segment", "Country", "Recommendation"]


def round_cols(df: DataFrame, cols: list[str], scale: int = 2) -> DataFrame:
    """Project ``cols``, rounding the double ones (like a frame-wide round(2))."""
    types = dict(df.dtypes)
    return df.select(*[rnd(F.col(c), scale).alias(c) if types[c] in ("double", "float") else F.col(c)
                       for c in cols])


def money_sum(c: str | Column) -> Column:
    """Order-free sum of a money double (decimal sum)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(38,6)")).cast("double")


# --- E1, E2, E3 -----------------------------------------------------------------

def group_summary(rfm: DataFrame, key: str, measures: dict[str, str]) -> DataFrame:
    """Count plus rounded means per key; null keys dropped (pandas groupby)."""
    return (rfm.where(F.col(key).isNotNull()).groupBy(key)
               .agg(F.count("CustomerID").alias("Count"),
                    *[rnd(exact_mean(src), 2).alias(name) for name, src in measures.items()]))


def segment_summary(rfm: DataFrame) -> DataFrame:
    return group_summary(rfm, "Segment", {"AvgRecency": "Recency", "AvgFrequency": "Frequency",
                                          "AvgMonetary": "Monetary", "AvgCLV": "CLV",
                                          "AvgChurnScore": "ChurnScore"})


def rfm_heatmap(rfm: DataFrame) -> DataFrame:
    return (rfm.groupBy("R_Score", "F_Score")
               .agg(F.count("CustomerID").alias("Count"),
                    rnd(exact_mean("Monetary"), 2).alias("AvgMonetary")))


def cluster_summary(rfm: DataFrame) -> DataFrame:
    return group_summary(rfm, "ClusterLabel", {"AvgRecency": "Recency", "AvgFrequency": "Frequency",
                                               "AvgMonetary": "Monetary", "AvgCLV": "CLV"})


# --- C9, C10 keyed samples ---------------------------------------------------------

def keyed_sample(df: DataFrame, n: int, seed: int = C.SEED, key: str = "CustomerID") -> DataFrame:
    """Exactly min(n, rows) rows, the same on every run and partitioning:
    the n smallest md5(key:seed) — a ``TakeOrderedAndProject``, no full sort."""
    return (df.withColumn("_h", keyed_hex(F.col(key), seed))
              .orderBy("_h", key).limit(n).drop("_h"))


def segment_scatter(rfm: DataFrame, n: int = 800) -> DataFrame:
    cols = ["CustomerID", "Recency", "Frequency", "Monetary", "CLV", "Segment", "ChurnRisk",
            "RFM_Score"]
    s = keyed_sample(rfm.select(*cols), n)
    return (round_cols(s, cols)
            .withColumn("BubbleRadius",
                        F.least(F.greatest(F.col("Frequency").cast("double"), F.lit(1.5)), F.lit(10.0))))


def cluster_scatter(rfm: DataFrame, n: int = 600) -> DataFrame:
    cols = ["CustomerID", "Recency", "Frequency", "Monetary", "CLV", "ClusterLabel", "Segment"]
    return round_cols(keyed_sample(rfm.select(*cols), n), cols)


# --- churn page: L1, E4–E8 ------------------------------------------------------------

def high_risk_customers(rfm: DataFrame, n: int = 20) -> DataFrame:
    top = (rfm.where(F.col("ChurnRisk") == "High")
              .orderBy(F.col("Monetary").desc(), F.col("CustomerID")).limit(n))
    return round_cols(top, HIGH_RISK_COLUMNS)


def churn_distribution(rfm: DataFrame) -> DataFrame:
    counts = rfm.where(F.col("ChurnRisk").isNotNull()).groupBy("ChurnRisk").agg(
        F.count(F.lit(1)).alias("Count"))
    # at most 3 rows: a global window is fine here
    return counts.withColumn("Share", pct(F.col("Count"), F.sum("Count").over(Window.partitionBy()), 1))


def churn_by_segment(rfm: DataFrame) -> DataFrame:
    return (rfm.where(F.col("Segment").isNotNull() & F.col("ChurnRisk").isNotNull())
               .groupBy("Segment").pivot("ChurnRisk", C.RISK_LEVELS).count()
               .na.fill(0, C.RISK_LEVELS))


def recency_by_risk(rfm: DataFrame) -> DataFrame:
    return (rfm.where(F.col("ChurnRisk").isNotNull()).groupBy("ChurnRisk")
               .agg(rnd(exact_mean("Recency"), 1).alias("AvgRecency")))


def churn_by_country(rfm: DataFrame, n: int = 8) -> DataFrame:
    top = (rfm.where((F.col("ChurnRisk") == "High") & F.col("Country").isNotNull())
              .groupBy("Country").agg(F.count(F.lit(1)).alias("Count"))
              .orderBy(F.col("Count").desc(), F.col("Country")).limit(n))
    return top.withColumn("PctOfLeader", pct(F.col("Count"), F.max("Count").over(Window.partitionBy()), 1))


def revenue_at_risk(rfm: DataFrame) -> DataFrame:
    return rfm.agg(rnd(F.coalesce(money_sum(F.when(F.col("ChurnRisk") == "High", F.col("Monetary"))),
                                  F.lit(0.0)), 2).alias("revenue_at_risk"))


# --- overview: E9, E10 -------------------------------------------------------------------

def overview_kpis(rfm: DataFrame) -> DataFrame:
    k = rfm.agg(F.count(F.lit(1)).alias("total_customers"),
                money_sum("Monetary").alias("total_revenue"),
                exact_mean("CLV").alias("avg_clv"),
                exact_mean("AvgOrderValue").alias("avg_order_value"),
                F.count_if(F.col("ChurnRisk") == "High").alias("high_churn_count"),
                F.count_if(F.col("Segment") == "Champions").alias("champions_count"))
    t, h = F.col("total_customers"), F.col("high_churn_count")
    return k.select("total_customers",
                    rnd(F.col("total_revenue"), 2).alias("total_revenue"),
                    rnd(F.col("avg_clv"), 2).alias("avg_clv"),
                    rnd(F.col("avg_order_value"), 2).alias("avg_order_value"),
                    "high_churn_count", "champions_count",
                    pct(h, t, 1).alias("churn_rate"),
                    pct(t - h, t, 1).alias("retention_rate"))


def stats_summary(rfm: DataFrame) -> DataFrame:
    """The statistics document's scalars (one row)."""
    return overview_kpis(rfm).drop("churn_rate", "retention_rate")


def stats_document(rfm: DataFrame) -> DataFrame:
    """B16 with the three count maps (segment, churn, cluster) as
    map<string, bigint> columns; the maps come from one small grouped pass."""
    counts = count_maps(rfm, with_clusters="ClusterLabel" in rfm.columns)
    maps = counts.groupBy().agg(*[
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("key", "Count")))))
         .alias(f"{k}_counts") for k in ("segment", "churn", "cluster")])
    return stats_summary(rfm).crossJoin(maps)


def count_maps(rfm: DataFrame, with_clusters: bool = False) -> DataFrame:
    """Segment / churn (/ cluster) counts as one long table in a single pass."""
    kinds = [F.struct(F.lit("segment").alias("kind"), F.col("Segment").alias("key")),
             F.struct(F.lit("churn").alias("kind"), F.col("ChurnRisk").alias("key"))]
    if with_clusters:
        kinds.append(F.struct(F.lit("cluster").alias("kind"), F.col("ClusterLabel").alias("key")))
    return (rfm.select(F.explode(F.array(*kinds)).alias("kv"))
               .select("kv.kind", "kv.key").where(F.col("key").isNotNull())
               .groupBy("kind", "key").agg(F.count(F.lit(1)).alias("Count")))


# --- insights: E12–E14 ---------------------------------------------------------------------

def insight_metrics(rfm: DataFrame) -> DataFrame:
    """One row of the numbers behind the insight cards."""
    seg_counts = (rfm.where(F.col("Segment").isNotNull()).groupBy("Segment")
                     .agg(F.count(F.lit(1)).alias("cnt")))
    # argmax over ≤ 5 segment rows; ties broken by name
    top = (seg_counts.orderBy(F.col("cnt").desc(), F.col("Segment")).limit(1)
                     .select(F.col("Segment").alias("top_segment"), F.col("cnt").alias("top_segment_count")))
    champ = F.col("Segment") == "Champions"
    m = rfm.agg(F.count(F.lit(1)).alias("total_customers"),
                F.count_if(F.col("ChurnRisk") == "High").alias("high_churn_count"),
                F.count_if(champ).alias("champions_count"),
                money_sum("Monetary").alias("total_revenue"),
                F.coalesce(money_sum(F.when(F.col("ChurnRisk") == "High", F.col("Monetary"))),
                           F.lit(0.0)).alias("risk_revenue"),
                money_sum(F.when(champ, F.col("Monetary"))).alias("champ_revenue"),
                exact_mean(F.when(champ, F.col("CLV"))).alias("champ_clv"))
    return m.crossJoin(top).select(
        "total_customers", "high_churn_count", "champions_count",
        pct(F.col("high_churn_count"), F.col("total_customers"), 1).alias("churn_rate"),
        rnd(F.col("risk_revenue"), 0).alias("revenue_at_risk"),
        rnd(F.col("champ_clv"), 2).alias("avg_clv_champions"),
        pct(F.col("champ_revenue"), F.col("total_revenue"), 1).alias("champions_revenue_share"),
        "top_segment", "top_segment_count")


# --- fixed values: insight cards (type, icon, title, body, action, page), in order ---
INSIGHT_CARDS = [
    ("warning", "⚠️", "{churn_rate}% Customers at High Churn Risk",
     "{high_churn_count} customers show high churn signals. Estimated revenue at risk: £{revenue_at_risk}. "
     "Immediate win-back campaigns recommended.",
     "View Churn Analysis", "churn"),
    ("success", "🏆", "Champions Segment Driving {champions_revenue_share}% Revenue",
     "{champions_count} Champions customers have an avg CLV of £{avg_clv_champions}. "
     "Focus on retention and upsell.",
     "Explore Segments", "segments"),
    ("info", "📈", "Revenue Forecasting Available",
     "ML-powered 6-month revenue forecast generated using historical trend analysis. "
     "Review projected revenue trajectory.",
     "View Forecast", "forecast"),
    ("info", "🎯", "Top Segment: {top_segment}",
     "{top_segment_count} customers classified as {top_segment}. "
     "Target them with tailored engagement strategies.",
     "View Customers", "customers"),
]


def insight_values() -> dict[str, Column]:
    """How each metric appears in the card text (thousands separators etc.)."""
    return {"churn_rate": F.col("churn_rate").cast("string"),
            "high_churn_count": F.format_number(F.col("high_churn_count"), 0),
            "revenue_at_risk": F.format_number(F.col("revenue_at_risk"), 0),
            "champions_revenue_share": F.col("champions_revenue_share").cast("string"),
            "champions_count": F.format_number(F.col("champions_count"), 0),
            "avg_clv_champions": F.format_number(F.col("avg_clv_champions"), 2),
            "top_segment": F.col("top_segment"),
            "top_segment_count": F.format_number(F.col("top_segment_count"), 0)}


def insight_rows(metrics: DataFrame) -> DataFrame:
    """The four insight cards as rows, built from the 1-row metrics."""
    vals = insight_values()
    cards = F.array(*[
        F.struct(F.lit(i + 1).alias("idx"), F.lit(t).alias("type"), F.lit(icon).alias("icon"),
                 fill(title, vals).alias("title"), fill(body, vals).alias("body"),
                 F.lit(action).alias("action"), F.lit(page).alias("page"))
        for i, (t, icon, title, body, action, page) in enumerate(INSIGHT_CARDS)])
    return metrics.select(F.explode(cards).alias("c")).select("c.*")


# --- customers page: C2–C5, C8, L3 --------------------------------------------------------------

def filter_customers(rfm: DataFrame, search: str = "", segment: str = "", churn: str = "") -> DataFrame:
    """Optional filters; an empty value means no filter.  ``search`` is a
    regular expression found anywhere in the id text."""
    df = rfm
    s = (search or "").strip()
    if s:
        df = df.where(F.col("CustomerID").cast("string").rlike(s))
    if segment:
        df = df.where(F.col("Segment") == segment)
    if churn:
        df = df.where(F.col("ChurnRisk") == churn)
    return df


def sort_spec(df: DataFrame, sort: str = "Monetary", direction: str = "desc") -> list[Column]:
    """Whitelisted sort column (unknown → Monetary desc) plus the id as tie-break."""
    if sort in df.columns:
        c = F.col(sort).asc() if direction == "asc" else F.col(sort).desc()
    else:
        c = F.col("Monetary").desc()
    return [c, F.col("CustomerID").asc()]


def customers_page(rfm: DataFrame, page: int = 1, per_page: int = 20, search: str = "",
                   segment: str = "", churn: str = "", sort: str = "Monetary",
                   direction: str = "desc") -> DataFrame:
    df = filter_customers(rfm, search, segment, churn)
    start = max(page - 1, 0) * per_page
    rows = df.orderBy(*sort_spec(df, sort, direction)).offset(start).limit(per_page)
    return round_cols(rows, EXPORT_COLUMNS)


def customers_page_after(rfm: DataFrame, after: tuple | None, per_page: int = 20, search: str = "",
                         segment: str = "", churn: str = "", sort: str = "Monetary",
                         direction: str = "desc") -> DataFrame:
    """Keyset page: the ``per_page`` rows that follow ``after`` = (sort value,
    CustomerID) of the previous page's last row in the same order.  The cost
    does not grow with the page number (no offset to skip)."""
    df = filter_customers(rfm, search, segment, churn)
    col = sort if sort in df.columns else "Monetary"
    desc = direction != "asc" if sort in df.columns else True
    if after is not None:
        v, last_id = after
        c, i = F.col(col), F.col("CustomerID")
        beyond = (c < F.lit(v)) if desc else (c > F.lit(v))
        df = df.where(beyond | ((c == F.lit(v)) & (i > F.lit(last_id))))
    rows = df.orderBy(*sort_spec(df, sort, direction)).limit(per_page)
    return round_cols(rows, EXPORT_COLUMNS)


def customers_page_info(rfm: DataFrame, page: int = 1, per_page: int = 20, search: str = "",
                        segment: str = "", churn: str = "") -> DataFrame:
    df = filter_customers(rfm, search, segment, churn)
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(per_page).alias("per_page"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(per_page))).cast("long").alias("pages"))


def customer_detail(rfm: DataFrame, customer_id: int) -> DataFrame:
    """Point lookup; an empty frame means not found."""
    return round_cols(rfm.where(F.col("CustomerID") == F.lit(customer_id)), rfm.columns)


def export_projection(rfm: DataFrame) -> DataFrame:
    """A10 pre-sink projection: 13 columns rounded to 2 dp."""
    return round_cols(rfm, EXPORT_COLUMNS)


def dedupe_report(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows; report before / after / removed."""
    before = df.agg(F.count(F.lit(1)).alias("rows_before"))
    after = df.dropDuplicates().agg(F.count(F.lit(1)).alias("rows_after"))
    return before.crossJoin(after).withColumn("removed", F.col("rows_before") - F.col("rows_after"))
