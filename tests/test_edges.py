"""Hand-made edge fixtures: nulls, constants, duplicates, zero months,
one-class labels, paging past the end, regex search, CSV quoting, missing
files, leakage guard."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from patronus.operators import dashboards as D
from patronus.operators import metrics as M
from patronus.operators import prep as P
from patronus.operators.features import FINAL, fit_preps
from patronus.operators import revenue as V
from patronus.operators.smote import SmoteError, smote
from patronus.sources import files as S
from patronus.sources import sinks as K

RFM_COLS = ("CustomerID long, Recency int, Frequency long, Monetary double, CLV double, ChurnScore double, "
            "ChurnRisk string, Segment string, RFM_Score int, Country string, AvgOrderValue double, "
            "UniqueProducts long, Recommendation string, R_Score int, F_Score int")


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [
        (1, 10, 5, 100.0, 50.0, 5.0, "Low", "Champions", 11, "France", 20.0, 3, "r", 4, 4),
        (2, 100, 1, 100.0, 0.0, 100.0, "High", "Lost", 3, None, 100.0, 1, "r", 1, 1),
        (3, 50, 2, 300.0, 10.0, 50.0, "Medium", None, 6, "Spain", 150.0, 2, "r", 2, 2),
        (12, 95, 1, 300.0, 0.0, 95.0, "High", "At Risk", 4, "Spain", 300.0, 1, "r", 1, 1),
        (112, 95, 1, 5.0, 0.0, 95.0, "High", "At Risk", 4, "Spain", 5.0, 1, "r", 1, 1),
    ]
    return spark.createDataFrame(rows, RFM_COLS)


def test_null_keys_dropped(tiny):
    seg = {r.Segment for r in D.segment_summary(tiny).collect()}
    assert None not in seg
    country = {r.Country for r in D.churn_by_country(tiny).collect()}
    assert country == {"Spain"}


def test_top_k_tie_break_by_id(tiny):
    ids = [r.CustomerID for r in D.high_risk_customers(tiny, 2).collect()]
    assert ids == [12, 2]


def test_page_past_end_and_pages(tiny):
    assert D.customers_page(tiny, page=9, per_page=2).count() == 0
    info = D.customers_page_info(tiny, page=9, per_page=2).first()
    assert (info.total, info.pages) == (5, 3)
    empty = D.customers_page_info(tiny, search="999").first()
    assert (empty.total, empty.pages) == (0, 1)


def test_search_is_regex_and_stripped(tiny):
    got = sorted(r.CustomerID for r in D.filter_customers(tiny, search="  ^1.$ ").collect())
    assert got == [12]
    assert D.filter_customers(tiny, search="").count() == 5


def test_minmax_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, c double")
    assert {r.c_norm for r in P.minmax(df, ["c"]).collect()} == {0.0}


def test_dedupe_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    r = D.dedupe_report(df).first()
    assert (r.rows_before, r.rows_after, r.removed) == (3, 2, 1)


def test_growth_zero_previous_month(spark):
    m = spark.createDataFrame([("2020-01", 0.0), ("2020-02", 10.0), ("2020-03", 15.0)],
                              "Month string, Revenue double")
    got = [r.growth for r in V.monthly_growth(m).orderBy("Month").collect()]
    assert got == [0.0, 0.0, 50.0]


def test_one_class_metrics_do_not_divide_by_zero(spark):
    p = spark.createDataFrame([("m", "test", -1, i, 0, 0, 0.1 * i) for i in range(5)],
                              "model string, split string, fold int, CustomerID long, label int, "
                              "prediction int, score double")
    r = M.classification_metrics(p).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (100.0, 0.0, 0.0, 0.0)
    assert M.roc_auc(p).first().auc == 0.0


def test_leakage_guard():
    with pytest.raises(P.LeakageError):
        P.check_no_leakage(["Recency", "CLV"])
    P.check_no_leakage(["Recency", "Country"])


def test_onehot_rare_unknown_and_drop_first(spark):
    fit_rows = spark.createDataFrame([("A",)] * 5 + [("B",)] * 5 + [("C",)] * 1, "Country string")
    df = spark.createDataFrame([("A",), ("B",), ("C",), ("Z",)], "Country string")
    for share, names, want in ((0.2, ["Country_B", "Country_infrequent_sklearn"], {"C": "Country_infrequent_sklearn", "Z": "Country_infrequent_sklearn"}),
                               (0.01, ["Country_B", "Country_C"], {"C": "Country_C", "Z": None})):
        prep = fit_preps(fit_rows, 0, share, numeric=[])[FINAL]
        assert prep.onehot_cols == names
        got = {r.Country: r.c for r in df.select("Country", prep.onehot_column().alias("c")).collect()}
        assert got == {"A": None, "B": "Country_B"} | want


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "Country string")
    assert P.mode_of(df, "Country").first().mode == "a"


def test_smote_needs_enough_minority(spark):
    df = spark.createDataFrame([(i, [float(i)], 1 if i < 3 else 0) for i in range(20)],
                               "CustomerID long, x array<double>, label int")
    with pytest.raises(SmoteError):
        smote(df)


def test_csv_quoted_comma_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="patronus-test-")
    p = os.path.join(d, "products.csv")
    with open(p, "w") as f:
        f.write('Product,Revenue\n"PAPER CRAFT , LITTLE BIRDIE",168469.6\nPLAIN NAME,10.5\n')
    rows = S.read_products_csv(spark, p).collect()
    assert rows[0].Product == "PAPER CRAFT , LITTLE BIRDIE" and rows[1].Revenue == 10.5


def test_missing_json_gives_empty_default(spark):
    df = S.read_model_results(spark, "/nonexistent/model_results.json")
    assert df.count() == 0 and "train_time" in df.columns


def test_results_and_stats_documents(spark):
    d = tempfile.mkdtemp(prefix="patronus-test-")
    rp = os.path.join(d, "r.json")
    with open(rp, "w") as f:
        f.write('{"B": {"accuracy": 1.0, "f1": 2.0, "overfitting": false, "train_time": 0.5},'
                ' "A": {"accuracy": 3.0, "f1": 4.0, "overfitting": true, "train_time": 1.5}}')
    r = S.read_model_results(spark, rp).orderBy("order").collect()
    assert [(x.order, x.model, x.f1) for x in r] == [(0, "B", 2.0), (1, "A", 4.0)]
    sp = os.path.join(d, "s.json")
    with open(sp, "w") as f:
        f.write('{"total_customers": 3, "total_revenue": 1.5, "avg_clv": 1.0, "avg_order_value": 2.0, '
                '"high_churn_count": 1, "champions_count": 1, "segment_counts": {"Lost": 2, "Champions": 1}, '
                '"churn_counts": {"High": 1}, "cluster_counts": {}}')
    long = S.stats_counts_long(S.read_stats_json(spark, sp)).collect()
    assert sorted((x.kind, x.key, x["count"]) for x in long) == [("churn", "High", 1), ("segment", "Champions", 1),
                                                                 ("segment", "Lost", 2)]


def test_export_csv_sink(spark, tiny):
    d = tempfile.mkdtemp(prefix="patronus-test-")
    path = K.export_customers_csv(tiny, d)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == D.EXPORT_COLUMNS and back.count() == 5


def test_forecast_document_reader(spark):
    d = tempfile.mkdtemp(prefix="patronus-test-")
    p = os.path.join(d, "forecast.json")
    with open(p, "w") as f:
        f.write('{"historical": [{"Month": "2011-11", "Revenue": 10.5}, {"Month": "2011-12", "Revenue": 7.0}], '
                '"forecast": [{"Month": "2012-01", "Revenue": 8.25}]}')
    rows = S.read_forecast_json(spark, p).orderBy("kind", "idx").collect()
    assert [(r.kind, r.idx, r.Month, r.Revenue) for r in rows] == [
        ("forecast", 0, "2012-01", 8.25), ("historical", 0, "2011-11", 10.5), ("historical", 1, "2011-12", 7.0)]


def test_keyset_pages_equal_offset_pages(spark, tiny):
    seen, after = [], None
    for page in range(1, 4):
        by_offset = [r.CustomerID for r in D.customers_page(tiny, page=page, per_page=2, sort="Recency",
                                                           direction="desc").collect()]
        rows = D.customers_page_after(tiny, after, per_page=2, sort="Recency", direction="desc").collect()
        assert [r.CustomerID for r in rows] == by_offset
        if rows:
            after = (rows[-1].Recency, rows[-1].CustomerID)
        seen += by_offset
    assert sorted(seen) == [1, 2, 3, 12, 112]


def test_stats_document_maps(spark, tiny):
    doc = D.stats_document(tiny.withColumn("ClusterLabel", F.lit("VIP"))).first()
    assert doc.total_customers == 5 and doc.high_churn_count == 3 and doc.champions_count == 1
    assert doc.segment_counts == {"At Risk": 2, "Champions": 1, "Lost": 1}
    assert doc.churn_counts == {"High": 3, "Low": 1, "Medium": 1}
    assert doc.cluster_counts == {"VIP": 5}
