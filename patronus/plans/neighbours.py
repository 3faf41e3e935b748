"""Neighbour queries (J5, M8, M9e) on raw whole-number columns, with SQL oracles.

Distances between whole numbers are exact, so neighbours, votes and the synthetic rows
of SMOTE can be stated in SQL: the oracle compares every pair, the queries prune.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from patronus import config as C
from patronus.functions.keyed import sql_keyed_uniform
from patronus.functions.numeric import rnd
from patronus.operators import prep as P
from patronus.operators.knn import knn, knn_vote
from patronus.operators.models import KNN_K
from patronus.operators.smote import smote
from patronus.plans.registry import oracle, query
from patronus.plans.sqlbits import R, with_base
from patronus.plans.training import TRAIN_INTERCEPT, labeled_profiles, labeled_sql, split_sql

RAW = ["Recency", "Frequency", "TotalItems", "UniqueProducts"]


def raw_rows(spark, sf):
    """(CustomerID, split, label, x) of all customers."""
    lab = labeled_profiles(spark, sf, TRAIN_INTERCEPT).select("CustomerID", "ChurnBinary", *RAW)
    return P.stratified_split(lab).select("CustomerID", "split", F.col("ChurnBinary").alias("label"),
                                          F.array(*[F.col(c).cast("double") for c in RAW]).alias("x"))


def _neighbours(spark, sf):
    rows = raw_rows(spark, sf)
    return knn(rows.where("split = 'test'"), rows.where("split = 'train'"), KNN_K, "CustomerID", "CustomerID")


_DISTANCE = "sqrt(" + " + ".join(f"CAST((q.{c} - r.{c}) * (q.{c} - r.{c}) AS DOUBLE)" for c in RAW) + ")"
_SPLIT = labeled_sql("base", TRAIN_INTERCEPT) + "," + split_sql()
_NEAR = _SPLIT + f""",
pair AS (SELECT q.CustomerID AS qid, r.CustomerID AS rid, r.ChurnBinary AS rlabel, {_DISTANCE} AS dist
         FROM spl q JOIN spl r ON q.split = 'test' AND r.split = 'train'),
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM pair
         QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, rid) <= {KNN_K})"""


@query("knn_neighbours")
def q_knn_neighbours(spark, sf):
    """The nearest training customers of every test customer."""
    return _neighbours(spark, sf).select("qid", "rid", "rank", "rlabel", rnd(F.col("dist"), 6).alias("dist"))


oracle("knn_neighbours", with_base(f"SELECT qid, rid, rank, rlabel, {R('dist', 6)} AS dist FROM near", _NEAR))


@query("knn_raw_scores")
def q_knn_raw_scores(spark, sf):
    """M9e: distance-weighted votes of the neighbours."""
    return knn_vote(_neighbours(spark, sf)).select(F.col("qid").alias("CustomerID"), rnd(F.col("score"), 6).alias("score"))


oracle("knn_raw_scores", with_base(f"""
SELECT qid AS CustomerID, {R('CASE WHEN count(*) FILTER (WHERE dist = 0) > 0 THEN avg(rlabel) FILTER (WHERE dist = 0) '
                             'ELSE sum(rlabel / dist) / sum(1 / dist) END', 6)} AS score
FROM near GROUP BY qid""", _NEAR))


@query("smote_raw_rows")
def q_smote_raw(spark, sf):
    """M8: the over-sampled training rows; synthetic ones have negative ids."""
    rows = raw_rows(spark, sf).where("split = 'train'").select("CustomerID", "label", "x")
    return smote(rows).select("CustomerID", "label", *[rnd(F.col("x")[i], 6).alias(c) for i, c in enumerate(RAW)])


def _u(stream: str) -> str:
    return sql_keyed_uniform("s", C.SEED, stream)


oracle("smote_raw_rows", with_base(f"""
SELECT CustomerID, ChurnBinary AS label, {', '.join(f'{R(c, 6)} AS {c}' for c in RAW)} FROM fit
UNION ALL
SELECT -(s + 1), (SELECT label FROM few),
       {', '.join(R(f'CAST(b.{c} AS DOUBLE) + u * (CAST(r.{c} AS DOUBLE) - CAST(b.{c} AS DOUBLE))', 6) for c in RAW)}
FROM draws JOIN mino b USING (brank) JOIN near ON near.qid = b.CustomerID AND near.rank = nn_rank
     JOIN mino r ON r.CustomerID = near.rid""", _SPLIT + f""",
fit AS (SELECT * FROM spl WHERE split = 'train'),
counts AS (SELECT ChurnBinary AS label, count(*) AS n FROM fit GROUP BY ChurnBinary),
few AS (SELECT label, n FROM counts ORDER BY n, label LIMIT 1),
mino AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(CustomerID AS VARCHAR) || ':{C.SEED}'), CustomerID) AS brank
         FROM fit WHERE ChurnBinary = (SELECT label FROM few)),
pair AS (SELECT q.CustomerID AS qid, r.CustomerID AS rid, {_DISTANCE} AS dist
         FROM mino q JOIN mino r ON q.CustomerID <> r.CustomerID),
near AS (SELECT qid, rid, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM pair),
draws AS (SELECT s, CAST(floor({_u('base')} * (SELECT n FROM few)) AS BIGINT) + 1 AS brank,
                 CAST(floor({_u('nn')} * {C.SMOTE_K}) AS BIGINT) + 1 AS nn_rank, {_u('gap')} AS u
          FROM range((SELECT CAST(max(n) - min(n) AS BIGINT) FROM counts)) AS t(s))"""))
