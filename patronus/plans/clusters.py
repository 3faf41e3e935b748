"""Cluster queries (B11, B12, E3, C9) with generated SQL oracles.

The oracle states the same k-means as a recursive CTE, one assignment and one
centre update per step until no centre moves by more than the tolerance, so
it is an independent statement of the converged result.
"""

from __future__ import annotations

import uuid

from patronus import config as C
from patronus.operators import clusters as K
from patronus.operators import dashboards as D
from patronus.plans.registry import oracle, query
from patronus.plans.sqlbits import MEAN, R, with_base
from patronus.session import scratch_path
from patronus.sources.customer_table import stored_profiles
from patronus.sources.files import RFM_SCHEMA, read_rfm_csv
from patronus.sources.sinks import write_csv
from patronus.sources.tables import tables


def clustered_profiles(spark, sf):
    return K.with_clusters(stored_profiles(tables(spark, sf)))


def _p(x: float) -> str:
    return repr(float(x))


def kmeans_ctes(k: int = K.K) -> str:
    probs = K.start_probs(k)
    feats = K.FEATURES
    zst = ", ".join([f"avg({f}) AS mean{j}, stddev_pop({f}) AS std{j}" for j, f in enumerate(feats)])
    qcols = []
    for i, p in enumerate(probs):
        for j, f in enumerate(feats):
            pp = 1 - p if f == "Recency" else p
            qcols.append(f"quantile_cont({f}, {_p(pp)}) AS q{i}_{j}")
    ctes = [f"zst AS (SELECT {zst} FROM rfm)",
            f"qs AS (SELECT {', '.join(qcols)} FROM rfm)"]
    zexpr = ", ".join(
        f"CASE WHEN coalesce(std{j}, 0) = 0 THEN 0.0 ELSE (CAST({f} AS DOUBLE) - mean{j}) / std{j} END AS z{j}"
        for j, f in enumerate(feats))
    ctes.append(f"pts AS (SELECT rfm.*, {zexpr} FROM rfm CROSS JOIN zst)")
    init = ", ".join(
        f"CASE WHEN coalesce(std{j}, 0) = 0 THEN 0.0 ELSE (q{i}_{j} - mean{j}) / std{j} END AS a{i}_{j}"
        for i in range(k) for j in range(3))
    ctes.append(f"c0 AS (SELECT {init} FROM zst CROSS JOIN qs)")

    def assign(cn: str) -> str:
        d = [" + ".join(f"(z{j} - {cn}.a{i}_{j}) * (z{j} - {cn}.a{i}_{j})" for j in range(3))
             for i in range(k)]
        whens = []
        for i in range(k - 1):
            cond = " AND ".join(f"({d[i]}) <= ({d[jj]})" for jj in range(i + 1, k))
            whens.append(f"WHEN {cond} THEN {i}")
        return f"CASE {' '.join(whens)} ELSE {k - 1} END"

    names = [f"a{i}_{j}" for i in range(k) for j in range(3)]
    step = ", ".join(f"coalesce(avg(z{j}) FILTER (k = {i}), any_value(a{i}_{j})) AS n{i}_{j}" for i in range(k) for j in range(3))
    old = ", ".join(f"any_value({n}) AS o{n}" for n in names)
    moved = ", ".join(f"abs(n{n[1:]} - o{n})" for n in names)
    ctes.append(f"""steps AS (
      SELECT 0 AS it, FALSE AS done, {', '.join(names)} FROM c0
      UNION ALL
      SELECT it + 1, greatest({moved}) <= {_p(K.TOL)}, {', '.join('n' + n[1:] for n in names)} FROM (
        SELECT it, {old}, {step} FROM (
          SELECT s.*, z0, z1, z2, {assign('s')} AS k FROM steps s CROSS JOIN pts WHERE NOT s.done) GROUP BY it))""")
    last = "centre"
    ctes.append("centre AS (SELECT * FROM steps WHERE done)")
    ctes.append(f"asg AS (SELECT pts.*, CAST({assign(last)} AS INTEGER) AS Cluster FROM pts CROSS JOIN {last})")
    ctes.append("""cst AS (SELECT Cluster, avg(Monetary) AS am, avg(Recency) AS ar FROM asg GROUP BY Cluster)""")
    ctes.append("""crk AS (SELECT Cluster, am, ar, row_number() OVER (ORDER BY am DESC, Cluster) AS mrank FROM cst)""")
    L = C.CLUSTER_LABELS
    ctes.append(f"""clab AS (SELECT Cluster, CASE WHEN mrank = 1 THEN '{L[0]}' WHEN mrank = 2 THEN '{L[1]}'
        WHEN row_number() OVER (PARTITION BY mrank <= 2 ORDER BY ar, Cluster) = 1 THEN '{L[2]}'
        ELSE '{L[3]}' END AS ClusterLabel FROM crk)""")
    ctes.append("crfm AS (SELECT asg.* EXCLUDE (z0, z1, z2), ClusterLabel FROM asg JOIN clab USING (Cluster))")
    return ",\n".join(ctes)


KM = kmeans_ctes()


@query("customer_clusters")
def q_customer_clusters(spark, sf):
    return clustered_profiles(spark, sf).select("CustomerID", "Cluster", "ClusterLabel")


oracle("customer_clusters", with_base("SELECT CustomerID, Cluster, ClusterLabel FROM crfm", KM))


@query("cluster_summary")
def q_cluster_summary(spark, sf):
    return D.cluster_summary(clustered_profiles(spark, sf))


oracle("cluster_summary", with_base(f"""
SELECT ClusterLabel, count(CustomerID) AS Count, {R(MEAN('Recency'), 2)} AS AvgRecency,
       {R(MEAN('Frequency'), 2)} AS AvgFrequency, {R(MEAN('Monetary'), 2)} AS AvgMonetary,
       {R(MEAN('CLV'), 2)} AS AvgCLV
FROM crfm WHERE ClusterLabel IS NOT NULL GROUP BY ClusterLabel""", KM))


@query("cluster_scatter_sample")
def q_cluster_scatter(spark, sf):
    return D.cluster_scatter(clustered_profiles(spark, sf), 600)


oracle("cluster_scatter_sample", with_base(f"""
SELECT CustomerID, Recency, Frequency, {R('Monetary', 2)} AS Monetary, {R('CLV', 2)} AS CLV, ClusterLabel, Segment
FROM crfm ORDER BY md5(CAST(CustomerID AS VARCHAR) || ':42'), CustomerID LIMIT 600""", KM))


@query("count_maps_with_clusters")
def q_count_maps_clusters(spark, sf):
    return D.count_maps(clustered_profiles(spark, sf), with_clusters=True)


oracle("count_maps_with_clusters", with_base("""
SELECT 'segment' AS kind, Segment AS key, count(*) AS Count FROM crfm WHERE Segment IS NOT NULL GROUP BY Segment
UNION ALL
SELECT 'churn', ChurnRisk, count(*) FROM crfm WHERE ChurnRisk IS NOT NULL GROUP BY ChurnRisk
UNION ALL
SELECT 'cluster', ClusterLabel, count(*) FROM crfm WHERE ClusterLabel IS NOT NULL GROUP BY ClusterLabel""", KM))


# A1: the whole 19-column customer table, written as CSV and scanned with its declared schema
@query("scan_rfm_full_csv")
def q_scan_rfm_full(spark, sf):
    path = scratch_path(spark, f"rfm-{uuid.uuid4().hex}")
    return read_rfm_csv(spark, write_csv(clustered_profiles(spark, sf).select(*RFM_SCHEMA.names), path))


oracle("scan_rfm_full_csv", with_base(f"SELECT {', '.join(RFM_SCHEMA.names)} FROM crfm", KM))
