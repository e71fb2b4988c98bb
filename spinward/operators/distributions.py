"""Quantiles and tail probabilities of report-sized numbers, by the mathematics library that Spark brings along."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import SparkSession


def _chi2(spark: SparkSession, dof: float):
    return spark.sparkContext._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(dof))


def poisson_limits(spark: SparkSession, k: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact limits of the mean of a Poisson count."""
    tail = (1 - confidence) / 2
    low = _chi2(spark, 2 * k).inverseCumulativeProbability(tail) / 2 if k > 0 else 0.0
    return low, _chi2(spark, 2 * k + 2).inverseCumulativeProbability(1 - tail) / 2


def chi2_p_value(spark: SparkSession, statistic: float, dof: float) -> float:
    """The probability of a greater statistic; 1 without degrees of freedom."""
    return 1 - _chi2(spark, dof).cumulativeProbability(float(statistic)) if dof > 0 else 1.0


def wilcoxon_signed_rank(a: list[float], b: list[float]) -> tuple[float, float]:
    """(statistic, two-sided p) of paired values, exact for up to 20 pairs without ties, else by the normal approximation.

    Pairs without a difference are left out; equal differences share their mean rank.
    """
    d = np.array(a, float) - np.array(b, float)
    d = d[d != 0]
    n = len(d)
    if n == 0:
        return 0.0, 1.0
    _, group, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    rank = (ends - (counts - 1) / 2)[group]
    plus, minus = rank[d > 0].sum(), rank[d < 0].sum()
    w = float(min(plus, minus))
    if n <= 20 and (counts == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return w, float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    return w, float(math.erfc(abs(w - mean) / math.sqrt(2 * var)))
