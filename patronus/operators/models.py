"""The six churn classifiers (M9a–f) as Spark jobs and MLlib estimators.

Every classifier is fitted on the frames of all plans (CustomerID, label, x
array<double>) and gives a scorer per plan: frame → (CustomerID, prediction int,
score double).  Those of ``TOGETHER`` fit all plans in the same jobs; the others run
plan by plan, side by side.

* Logistic Regression: L2, C = 0.8, class-balanced weights, second-order steps
  (``operators.logistic``).
* Decision Tree: depth 5, min 15 rows per leaf.
* Random Forest: 160 trees, depth 8, min 10 rows per leaf, sqrt features.
* XGBoost: 140 rounds, depth 3, step 0.05, row and column subsampling 0.8, min child
  weight 3, L1 0.5, L2 1.5, gamma 0.1 (``operators.boosting``, 256 bins).
* KNN: k = 25, inverse-distance vote, exact blocked search (``knn``).
* Gradient Boosting: 120 rounds, depth 2, min 15 rows per leaf, step 0.04, row
  subsampling 0.85, leaves re-estimated by a Newton step (``operators.boosting``).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronus import config as C
from patronus.operators.boosting import Booster, fit_boosters
from patronus.operators.knn import RefCells, knn, knn_vote
from patronus.operators.logistic import fit_logreg_plans

Scorer = Callable[[DataFrame], DataFrame]
KNN_K = 25


def _vec(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("x"))


def _mllib_scorer(model, key: str = "CustomerID") -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        out = model.transform(_vec(df))
        return out.select(key, F.col("prediction").cast("int").alias("prediction"),
                          vector_to_array("probability")[1].alias("score"))
    return score


def fit_tree(df: DataFrame, seed: int = C.SEED):
    return DecisionTreeClassifier(maxDepth=5, minInstancesPerNode=15, maxBins=256, seed=seed,
                                              labelCol="label").fit(_vec(df))


def fit_forest(df: DataFrame, seed: int = C.SEED):
    # node ids are kept with the rows: no row walks 160 trees from their roots at every level
    return RandomForestClassifier(numTrees=160, maxDepth=8, minInstancesPerNode=10,
                                              featureSubsetStrategy="sqrt", maxBins=256, seed=seed,
                                              labelCol="label", cacheNodeIds=True).fit(_vec(df))


class KnnModel:
    """Lazy k-NN 'model': the (checkpointed) fit rows themselves."""

    def __init__(self, fit_rows: DataFrame, k: int = KNN_K):
        self.fit_rows = fit_rows
        self.k = k
        self.featureImportances = None
        self._cells = None

    def scorer(self, key: str = "CustomerID") -> Scorer:
        def score(df: DataFrame) -> DataFrame:
            if self._cells is None:              # the reference side is prepared once per model
                self._cells = RefCells(self.fit_rows, key, "x", "label")
            nn = knn(df, None, self.k, key, key, vec="x", rlabel="label", prepared=self._cells, zero_alone=True)
            return knn_vote(nn).select(F.col("qid").alias(key), "prediction", "score")
        return score


def fit_knn(df: DataFrame, seed: int = C.SEED):
    return KnnModel(df)


#: The settings of the two boosters.
XGBOOST = Booster("newton", rounds=140, depth=3, eta=0.05, subsample=0.8, colsample=0.8, min_child_weight=3.0, alpha=0.5, lam=1.5, gamma=0.1)
GRADIENT_BOOSTING = Booster("friedman", rounds=120, depth=2, eta=0.04, subsample=0.85, colsample=1.0, min_leaf=15)

TOGETHER = {
    "Logistic Regression": fit_logreg_plans,
    "XGBoost": lambda fits: fit_boosters(fits, XGBOOST),
    "Gradient Boosting": lambda fits: fit_boosters(fits, GRADIENT_BOOSTING),
}
ONE_BY_ONE = {"Decision Tree": fit_tree, "Random Forest": fit_forest, "KNN": fit_knn}


def fit_plans(name: str, fits: list[DataFrame], workers: int = 6) -> list:
    """The model of every plan."""
    if name in TOGETHER:
        return TOGETHER[name](fits)
    with ThreadPoolExecutor(max_workers=workers) as ex:
        return list(ex.map(ONE_BY_ONE[name], fits))


def scorer_of(model) -> Scorer:
    return model.scorer() if hasattr(model, "scorer") else _mllib_scorer(model)


def importances(model, names: list[str]) -> list[tuple[str, float]] | None:
    fi = getattr(model, "featureImportances", None)
    if fi is None:
        return None
    vals = fi.toArray().tolist()
    return [(n, float(v)) for n, v in zip(names, vals)]
