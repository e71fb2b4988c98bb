"""Model fitting by MLlib: estimators, expanding-window validation, searches and probability calibration.

Gradient-boosted trees of MLlib stand in for both boosting libraries of the field; they take imputed inputs with
indicators, since MLlib has no routing of missing values.
"""

from __future__ import annotations

import ast
import itertools
import math
import random
import time
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinward.operators.features import Preparation, balanced_weights, one_hot, time_folds
from spinward.operators.metrics import average_precision, threshold_sweep
from spinward.operators.stats import stratified_sample
from spinward.session import ship

Fit = Callable[[DataFrame], Model]


def assemble(rows: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in inputs])))


def logistic(c: float = 1.0, l1_ratio: float = 0.0, balanced: bool = True) -> Fit:
    """The objective of C times the sum of losses plus the penalty: regParam is 1 / (C * sum of weights)."""

    def fit(rows: DataFrame) -> Model:
        n = rows.agg(F.sum("weight") if balanced else F.count("*").cast("double")).first()[0] or 1.0
        lr = LogisticRegression(regParam=1 / (c * n), elasticNetParam=l1_ratio, standardization=False, maxIter=200, tol=1e-8)
        return (lr.setWeightCol("weight") if balanced else lr).fit(rows)

    return fit


def tree(max_depth: int = 8, impurity: str = "gini", min_leaf: int = 20) -> Fit:
    return lambda rows: DecisionTreeClassifier(maxDepth=max_depth, impurity=impurity, minInstancesPerNode=min_leaf, weightCol="weight", seed=42).fit(rows)


def forest(trees: int = 50, max_depth: int = 8, min_leaf: int = 5) -> Fit:
    return lambda rows: RandomForestClassifier(numTrees=trees, maxDepth=max_depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", weightCol="weight", seed=42).fit(rows)


def boosted(rounds: int = 20, max_depth: int = 4, step: float = 0.1, subsample: float = 0.8) -> Fit:
    return lambda rows: GBTClassifier(maxIter=rounds, maxDepth=max_depth, stepSize=step, subsamplingRate=subsample, weightCol="weight", seed=42).fit(rows)


class KernelMap:
    """Nystroem features of a radial kernel: landmarks are a bounded sample of training rows."""

    def __init__(self, gamma: float, components: int = 100) -> None:
        self.gamma, self.components = gamma, components

    def fit(self, rows: DataFrame, keys: Sequence[str]) -> KernelMap:
        some = stratified_sample(rows.withColumn("_one", F.lit(1)), "_one", self.components, keys).select(vector_to_array("features").alias("x"))
        self.landmarks = np.array([r.x for r in some.collect()])
        u, s, vt = np.linalg.svd(self._kernel(self.landmarks))
        self.whiten = (u / np.sqrt(np.maximum(s, 1e-12))) @ vt
        return self

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        d = (x**2).sum(1)[:, None] + (self.landmarks**2).sum(1)[None] - 2 * x @ self.landmarks.T
        return np.exp(-self.gamma * np.maximum(d, 0))

    def apply(self, rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(self._kernel(np.stack(x.to_numpy())) @ self.whiten.T)) if len(x) else pd.Series([], dtype=object)

        return rows.withColumn("features", array_to_vector(mapped(vector_to_array("features"))))


def svm(c: float = 1.0) -> Fit:
    def fit(rows: DataFrame) -> Model:
        n = rows.agg(F.sum("weight")).first()[0] or 1.0
        return LinearSVC(regParam=1 / (c * n), weightCol="weight", maxIter=50, standardization=False).fit(rows)

    return fit


def predict(model: Model, rows: DataFrame, keys: Sequence[str] = ("serial_number", "window", "label")) -> DataFrame:
    """Keys and `prob`: the probability of label 1, or the margin where the model has no probabilities."""
    out = model.transform(rows)
    column = "probability" if "probability" in out.columns else "rawPrediction"
    return out.select(*keys, vector_to_array(column)[1].alias("prob"))


def prepared(train: DataFrame, others: Iterable[DataFrame], numeric: Sequence[str], *, log: bool = True, scale: bool = True) -> list[DataFrame]:
    """The training rows and other ones, imputed, transformed, with vendor columns, weights (training) and vectors."""
    steps = Preparation(list(numeric), log, scale).fit(train)
    inputs = None
    out = []
    for i, rows in enumerate([train, *others]):
        rows = one_hot(steps.apply(rows), "vendor")
        inputs = inputs or [*steps.outputs(), *[c for c in rows.columns if c.startswith("vendor_")]]
        rows = assemble(rows, inputs)
        out.append(balanced_weights(rows) if i == 0 else rows)
    return out


def evaluate(scored: DataFrame, threshold: float = 0.5) -> dict[str, float]:
    y = F.col("label").cast("int")
    ap = average_precision(scored, "prob", y).first()[0]
    at = threshold_sweep(scored, "prob", y, [threshold]).first()
    return {"pr_auc": float(ap or 0.0), "precision": at.precision, "recall": at.recall, "f1": at.f1}


def cross_validate(rows: DataFrame, fit: Fit, numeric: Sequence[str], *, n_folds: int = 4, gap: int = 1, threshold: float = 0.5, **prepare: bool) -> list[dict[str, float]]:
    """Measures of each expanding fold; folds without both labels in training are left out."""
    windows = [r.window for r in rows.select("window").distinct().collect()]
    out = []
    for k, (train, valid) in enumerate(time_folds(windows, n_folds, gap)):
        a, b = rows.where(F.col("window").isin(train)), rows.where(F.col("window").isin(valid))
        if not train or a.select("label").distinct().count() < 2:
            continue
        a, b = prepared(a, [b], numeric, **prepare)
        began = time.time()
        model = fit(a.cache())
        spent = time.time() - began
        out.append({"fold": k, "fit_seconds": spent, **evaluate(predict(model, b), threshold)})
        a.unpersist()
    return out


def search(rows: DataFrame, make: Callable[..., Fit], grid: dict[str, Sequence], numeric: Sequence[str], *, draws: int | None = None, seed: int = 42, **options) -> DataFrame:
    """Ranked results of all combinations of `grid`, or of `draws` of them: mean and population deviation over folds."""
    names = list(grid)
    combos = list(itertools.product(*grid.values()))
    if draws is not None and draws < len(combos):
        combos = random.Random(seed).sample(combos, draws)
    out = []
    for combo in combos:
        folds = cross_validate(rows, make(**dict(zip(names, combo, strict=True))), numeric, **options)
        if folds:
            m = {k: np.array([f[k] for f in folds]) for k in ("pr_auc", "precision", "recall", "f1", "fit_seconds")}
            out.append((str(dict(zip(names, combo, strict=True))), *[float(x) for k in ("pr_auc", "precision", "recall", "f1") for x in (m[k].mean(), m[k].std())], float(m["fit_seconds"].mean())))
    out.sort(key=lambda r: (-r[1], r[0]))
    ranks = [1 + sum(o[1] > r[1] for o in out) for r in out]
    schema = "params string, pr_auc double, pr_auc_std double, precision double, precision_std double, recall double, recall_std double, f1 double, f1_std double, mean_fit_seconds double, pr_auc_rank int"
    return rows.sparkSession.createDataFrame([(*r, k) for r, k in zip(out, ranks, strict=True)], schema)


def refit(rows: DataFrame, make: Callable[..., Fit], ranked: DataFrame, numeric: Sequence[str], **prepare: bool) -> tuple[dict, Model, list[DataFrame]]:
    """The best parameters of a search by PR-AUC, a model fitted with them on all rows, and the rows as it takes them."""
    best = ast.literal_eval(ranked.orderBy(F.desc("pr_auc"), "params").first().params)
    train = prepared(rows, [], numeric, **prepare)[0].cache()
    try:
        return best, make(**best)(train), [train]
    finally:
        train.unpersist()


def platt(scored: DataFrame, half: str = "half", prob: str = "prob") -> DataFrame:
    """Probabilities of half B calibrated by a logistic model of the log odds, fitted on half A."""
    p = F.greatest(F.least(F.col(prob), F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = scored.withColumn("features", array_to_vector(F.array(F.log(p / (1 - p)))))
    fitted = rows.where(F.col(half) == "A")
    n = fitted.count()
    model = LogisticRegression(regParam=1 / max(1, n), standardization=False, maxIter=200, tol=1e-9).fit(fitted)
    out = model.transform(rows.where(F.col(half) == "B"))
    return out.select(*scored.columns, vector_to_array("probability")[1].alias("calibrated"))


def log_odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))
