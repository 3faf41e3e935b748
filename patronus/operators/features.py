"""Feature preparation of all plans from one set of per-fold statistics (M2–M6).

median imputation → standardisation (population σ) for the 7 numeric features; mode
imputation → one-hot with a rare bucket for Country; the result is one ``x``
array<double> column.

A plan is fitted on the training rows outside its fold, so its statistics are those
of all folds less one.  Three jobs serve all plans:

1. count, nulls, mean and squared deviations per fold and feature, merged by the
   parallel formula (a plan's mean is taken after its own median imputation);
2. how often each value occurs per fold (written), for numbers and categories alike;
3. from these counts, running totals of every plan at once: medians, modes, kept
   categories and whether any is rare.

Only what a plan keeps reaches the driver: at most 1 / min_frequency categories.
All statistics are literals afterwards, so a transform is a projection: no join, no
broadcast, no window over the categories.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronus import config as C
from patronus.operators import prep as P
from patronus.operators.quantiles import search

FINAL = -1  # the plan fitted on all training rows


@dataclass
class Prepared:
    medians: dict[str, float | None] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    mode: str | None = None
    kept: list[str] = field(default_factory=list)  # sorted; the first one has no column
    has_rare: bool = False

    @property
    def onehot_cols(self) -> list[str]:
        return [f"Country_{c}" for c in self.kept[1:]] + ([C.RARE_BUCKET] if self.has_rare else [])

    @property
    def feature_names(self) -> list[str]:
        return P.feature_names(self.onehot_cols)

    def scaled(self, c: str) -> Column:
        if not self.deviations[c]:
            return F.lit(0.0)
        v = F.col(c).cast("double")
        v = F.coalesce(v, F.lit(float(self.medians[c]))) if self.medians[c] is not None else v
        return (v - F.lit(self.means[c])) / F.lit(self.deviations[c])

    def onehot_column(self, col: str = "Country") -> Column:
        """The active output column: null for the dropped category, and for values never
        seen where there is no rare bucket."""
        c = F.coalesce(F.col(col), F.lit(self.mode)) if self.mode is not None else F.col(col)
        rare = F.lit(C.RARE_BUCKET) if self.has_rare else F.lit(None).cast("string")
        if not self.kept:
            return F.when(c.isNotNull(), rare) if self.has_rare else rare
        known = c.isin(*self.kept[1:]) if self.kept[1:] else F.lit(False)
        return F.when(c == self.kept[0], F.lit(None).cast("string")).when(known, F.concat(F.lit(f"{col}_"), c)).otherwise(rare)

    def transform(self, df: DataFrame, key: str = "CustomerID", label: str = "ChurnBinary") -> DataFrame:
        return self.with_x(df).select(F.col(key), F.col(label).cast("int").alias("label"), "x")

    def with_x(self, df: DataFrame) -> DataFrame:
        """``df`` with the feature vector added; no label or key is needed."""
        x = F.array(*[self.scaled(c) for c in C.NUMERIC_FEATURES],
                    *[F.when(F.col("_active") == n, F.lit(1.0)).otherwise(F.lit(0.0)) for n in self.onehot_cols])
        return df.withColumn("_active", self.onehot_column()).withColumn("x", x).drop("_active")

    def as_dict(self) -> dict:
        return asdict(self)


def _merged(parts: list[tuple[int, float, float]]) -> tuple[int, float, float]:
    """(count, mean, squared deviations) of several groups together."""
    n, mean, dev = 0, 0.0, 0.0
    for k, m, d in parts:
        if not k:
            continue
        delta, n = m - mean, n + k
        dev += d + delta * delta * (n - k) * k / n
        mean += delta * k / n
    return n, mean, dev


def fit_preps(rows: DataFrame, folds: int = 0, min_frequency: float = C.ONEHOT_MIN_FREQUENCY, numeric: list[str] | None = None,
              col: str = "Country", per_bucket: int = 2_000_000) -> dict[int, Prepared]:
    """plan → statistics: ``FINAL`` over all ``rows``, and f = 0 … folds − 1 over those
    whose ``fold`` is not f."""
    numeric = C.NUMERIC_FEATURES if numeric is None else numeric
    fold = F.col("fold") if folds else F.lit(0)
    parts, plans = max(folds, 1), [FINAL, *range(folds)]
    values = [F.col(c).cast("double") for c in numeric]
    # 1: per fold (folds rows)
    stats = {r["_f"]: r for r in rows.groupBy(fold.alias("_f")).agg(
        F.count(F.lit(1)).alias("n"), F.count(col).alias("n_cat"), *[F.count(v).alias(f"n_{c}") for c, v in zip(numeric, values, strict=True)],
        *[F.avg(v).alias(f"m_{c}") for c, v in zip(numeric, values, strict=True)],
        *[F.var_pop(v).alias(f"v_{c}") for c, v in zip(numeric, values, strict=True)]).collect()}

    def of(name: str) -> list:
        return [stats[f][name] if f in stats else 0 for f in range(parts)]

    def rows_in(name: str, plan: int) -> int:
        return sum(n for f, n in enumerate(of(name)) if f != plan)
    # 2: occurrences of each value per fold
    items = [F.struct(F.lit(c).alias("what"), v.alias("v"), F.lit(None).cast("string").alias("s")) for c, v in zip(numeric, values, strict=True)]
    items.append(F.struct(F.lit("").alias("what"), F.lit(None).cast("double").alias("v"), F.col(col).cast("string").alias("s")))
    long = rows.select(fold.alias("_f"), F.explode(F.array(*items)).alias("x")).select("_f", "x.*").where("v is not null or s is not null")
    seen = long.groupBy("what", "v", "s").agg(*[F.count_if(F.col("_f") == f).alias(f"f{f}") for f in range(parts)]).checkpoint(eager=True)
    everywhere = sum((F.col(f"f{f}") for f in range(1, parts)), F.col("f0"))
    counts = [(everywhere if p == FINAL else everywhere - F.col(f"f{p}")).alias(f"c{i}") for i, p in enumerate(plans)]
    per_plan = seen.select("what", "v", "s", *counts)
    # 3: medians from running totals per bucket of values, categories from their counts
    numbers = per_plan.where(F.col("what") != "")
    bucket, most = F.lit(0), max((rows_in(f"n_{c}", FINAL) for c in numeric), default=0)
    if most > per_bucket:
        cuts = min(1024, math.ceil(most / per_bucket))
        shares = [i / cuts for i in range(1, cuts)]
        bounds = {r["what"]: sorted(set(r["q"])) for r in numbers.groupBy("what").agg(F.percentile_approx("v", shares, 10000).alias("q")).collect()}
        for what, splits in bounds.items():
            bucket = F.when(F.col("what") == what, search(F.col("v"), splits)).otherwise(bucket)
    numbers = numbers.withColumn("b", bucket)
    names = [f"c{i}" for i in range(len(plans))]
    offsets = numbers.groupBy("what", "b").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.partitionBy("what").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("what", "b", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"o_{n}") for n in names])
    within = Window.partitionBy("what", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = numbers.join(F.broadcast(offsets), ["what", "b"])  # at most features × 1024 rows
    ranked = ranked.select("what", "v", *names, *[(F.col(f"o_{n}") + F.sum(n).over(within)).alias(f"e_{n}") for n in names])
    middles, at = [], {}
    for i, p in enumerate(plans):
        for c in numeric:
            n = rows_in(f"n_{c}", p)
            for k in sorted({(n - 1) // 2, n // 2}) if n else []:
                at[p, c, k] = f"q{len(at)}"
                hit = (F.col("what") == c) & (F.col(f"e_c{i}") > k) & (F.col(f"e_c{i}") - F.col(f"c{i}") <= k)
                middles.append(F.max(F.when(hit, F.col("v"))).alias(at[p, c, k]))
    cats = per_plan.where(F.col("what") == "")
    big = [F.col(f"c{i}") >= F.lit(min_frequency) * F.lit(rows_in("n_cat", p)) for i, p in enumerate(plans)]
    some = big[0]
    for b in big[1:]:
        some = some | b
    picks = [F.collect_list(F.when((F.col("what") == "") & some, F.struct("s", *names))).alias("big")]
    for i, p in enumerate(plans):
        there = (F.col("what") == "") & (F.col(f"c{i}") > 0)
        rare = F.col(f"c{i}") < F.lit(min_frequency) * F.lit(rows_in("n", p))
        picks += [F.min(F.when(there, F.struct((-F.col(f"c{i}")).alias("c"), "s"))).alias(f"mode{i}"), F.count_if(there & rare).alias(f"rare{i}")]
    everything = ranked.unionByName(cats.select("what", "s", *names), allowMissingColumns=True)
    found = everything.agg(*middles, *picks).first()

    out = {}
    for i, p in enumerate(plans):
        prep = Prepared()
        total = rows_in("n", p)
        for c in numeric:
            n = rows_in(f"n_{c}", p)
            mid = [found[at[p, c, k]] for k in sorted({(n - 1) // 2, n // 2})] if n else []
            prep.medians[c] = sum(mid) / len(mid) if mid else None
            groups = [(stats[f][f"n_{c}"], stats[f][f"m_{c}"], (stats[f][f"v_{c}"] or 0.0) * stats[f][f"n_{c}"])
                      for f in stats if f != p and stats[f][f"n_{c}"]]
            if mid and total > n:
                groups.append((total - n, prep.medians[c], 0.0))
            n, mean, dev = _merged(groups)
            prep.means[c], prep.deviations[c] = mean, math.sqrt(dev / n) if n else 0.0
        mode, n_rare = found[f"mode{i}"], found[f"rare{i}"]
        if mode is not None:
            prep.mode, missing = mode["s"], total - rows_in("n_cat", p)
            count = {r["s"]: r[f"c{i}"] for r in found["big"]} | {mode["s"]: -mode["c"] + missing}
            prep.kept = sorted(s for s, n in count.items() if n > 0 and n >= min_frequency * total)
            if -mode["c"] < min_frequency * total <= -mode["c"] + missing:
                n_rare -= 1  # the mode is kept once missing values count as it
            prep.has_rare = n_rare > 0
        out[p] = prep
    return out


def fit_prep(fit_rows: DataFrame, min_frequency: float = C.ONEHOT_MIN_FREQUENCY) -> Prepared:
    return fit_preps(fit_rows, 0, min_frequency)[FINAL]
