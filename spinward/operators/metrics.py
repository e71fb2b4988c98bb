"""Measures of ranked and probabilistic predictions. All of them start from counts by distinct score."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinward.functions.columns import share
from spinward.operators.ranks import quantiles, running_totals
from spinward.operators.stats import auc_of


def by_score(df: DataFrame, score: str, label: Column) -> DataFrame:
    return df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(label.cast("long")).alias("pos"), F.count("*").alias("n"))


def pr_curve(df: DataFrame, score: str, label: Column) -> DataFrame:
    """(score, pos, n, tp, predicted, precision, recall) from the highest score down."""
    counts = by_score(df, score, label)
    all_pos = counts.agg(F.sum("pos").alias("_all"))
    out = running_totals(counts, score, ["pos", "n"], descending=True).crossJoin(F.broadcast(all_pos))  # one row
    return out.select(score, "pos", "n", F.col("pos_to").alias("tp"), F.col("n_to").alias("predicted"), (F.col("pos_to") / F.col("n_to")).alias("precision"), share(F.col("pos_to"), F.col("_all")).alias("recall"))


def average_precision(df: DataFrame, score: str, label: Column) -> DataFrame:
    """The sum over distinct scores of precision times the step in recall."""
    curve = pr_curve(df, score, label)
    return curve.agg(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos").cast("double")).alias("average_precision"))


def roc_auc(df: DataFrame, score: str, label: Column) -> DataFrame:
    return auc_of(df, score, label).select(F.col("auc").alias("roc_auc"))


def threshold_sweep(df: DataFrame, score: str, label: Column, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1); measures without a case are 0. One aggregate for all thresholds."""
    hit = lambda t: F.col(score) >= float(t)
    wide = df.agg(F.count_if(label == 1).alias("_pos"), *[f for i, t in enumerate(thresholds) for f in (F.count_if(hit(t) & (label == 1)).alias(f"_tp{i}"), F.count_if(hit(t)).alias(f"_p{i}"))])
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"), (F.col(f"_p{i}") - F.col(f"_tp{i}")).alias("fp"), (F.col("_pos") - F.col(f"_tp{i}")).alias("fn")) for i, t in enumerate(thresholds)])
    out = wide.select(F.explode(cells).alias("_c")).select("_c.*")
    tp = F.col("tp")
    return out.select("*", share(tp, tp + F.col("fp")).alias("precision"), share(tp, tp + F.col("fn")).alias("recall"), share(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def brier(df: DataFrame, score: str, label: Column) -> DataFrame:
    return df.agg(F.avg((F.col(score) - label) * (F.col(score) - label)).alias("brier"))


def budget_table(df: DataFrame, score: str, label: Column, ties: Sequence[str], per_thousand: Sequence[float], rule: Column | None = None) -> DataFrame:
    """Precision and recall of the floor(rows * budget / 1000) rows of highest score, of a yes/no rule and of chance.

    Scores are added up first; only rows that share the score where a budget ends are ordered, by `ties`. Three jobs, however
    many budgets there are.
    """
    spark = df.sparkSession
    rule = rule if rule is not None else F.lit(0)
    totals = df.agg(F.count("*").alias("n"), F.sum(label.cast("long")).alias("pos"), F.sum(rule.cast("long")).alias("rule_n"), F.sum((rule * label).cast("long")).alias("rule_tp")).first()
    n, pos, rule_n, rule_tp = (int(x or 0) for x in totals)
    curve = running_totals(by_score(df, score, label), score, ["pos", "n"], descending=True)
    want = [(float(k), int(n * k / 1000)) for k in per_thousand]
    within = lambda m: F.col("n_to") <= m
    found = curve.agg(*[f for i, (_, m) in enumerate(want) for f in (F.max(F.when(within(m), F.col("n_to"))).alias(f"n{i}"), F.sum(F.when(within(m), F.col("pos"))).alias(f"tp{i}"), F.max(F.when(~within(m), F.col(score))).alias(f"s{i}"))]).first()
    open_ = {i: m - (found[f"n{i}"] or 0) for i, (_, m) in enumerate(want) if m > (found[f"n{i}"] or 0) and found[f"s{i}"] is not None}
    edges = [df.where(F.col(score) == found[f"s{i}"]).orderBy(*ties).limit(left).agg(F.lit(i).alias("i"), F.sum(label.cast("long")).alias("x")) for i, left in open_.items()]
    more = {r.i: r.x or 0 for r in functools.reduce(DataFrame.unionByName, edges).collect()} if edges else {}  # a row for each budget
    out = []
    for i, (k, m) in enumerate(want):
        tp = (found[f"tp{i}"] or 0) + more.get(i, 0)
        out.append((k, m, tp / m if m else 0.0, tp / pos if pos else 0.0, rule_tp / rule_n if rule_n else 0.0, (rule_tp / pos if pos else 0.0) * min(m / rule_n, 1.0) if rule_n else 0.0, pos / n if n else 0.0, m / n if n else 0.0))
    return spark.createDataFrame(out, "per_thousand double, budget long, precision double, recall double, rule_precision double, rule_recall double, chance_precision double, chance_recall double")


def max_f1(df: DataFrame, score: str, label: Column) -> DataFrame:
    """The threshold of the greatest F1, the lowest of several."""
    curve = pr_curve(df, score, label)
    f1 = F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-12), 12)
    best = curve.withColumn("f1", f1).agg(F.max_by(F.struct(F.col(score).alias("threshold"), "precision", "recall", "f1"), F.struct(F.col("f1"), -F.col(score))).alias("_b"))
    return best.select("_b.*")


def calibration_ratio(df: DataFrame, score: str, label: Column) -> DataFrame:
    mean = F.avg(label.cast("double"))
    return df.agg(F.avg(score).alias("mean_predicted"), mean.alias("mean_actual"), F.try_divide(F.avg(score), mean).alias("ratio"))


def reliability(df: DataFrame, score: str, label: Column, bins: int = 10) -> DataFrame:
    """Mean prediction and rate by quantile bins, closed on the right; equal edges are one."""
    got = quantiles(df.select(F.col(score).cast("double").alias("x")), [i / bins for i in range(bins + 1)], by=()).first()
    edges = sorted(set(got.q)) if got and got.q[0] is not None else []
    if len(edges) < 2:
        edges = [edges[0] - 1, edges[0]] if edges else [0.0, 1.0]
    marks = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    of = F.size(F.filter(marks, lambda m: F.col(score) > m)) if len(edges) > 2 else F.lit(0)
    return df.where(F.col(score).isNotNull()).groupBy(of.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_predicted"), F.avg(label.cast("double")).alias("mean_actual"))


def rule_baseline(df: DataFrame, value: str, label: Column) -> DataFrame:
    """A failure is predicted where the value is above 0; missing values predict none."""
    hit = F.coalesce(F.col(value) > 0, F.lit(False))
    rows = df.select(hit.cast("int").alias("flag"), label.alias("y"))
    tp, p = F.count_if((F.col("flag") == 1) & (F.col("y") == 1)), F.count_if(F.col("flag") == 1)
    pos = F.count_if(F.col("y") == 1)
    return rows.agg(p.alias("flagged"), tp.alias("tp"), share(tp, p).alias("precision"), share(tp, pos).alias("recall"), share(2 * tp, p + pos).alias("f1"))


def summary_matrix(df: DataFrame, scores: Sequence[str], label: Column, ties: Sequence[str], per_thousand: float = 1.0) -> DataFrame:
    """(model, average_precision, precision_at, recall_at) of several score columns."""
    out = None
    for s in scores:
        one = average_precision(df, s, label).crossJoin(budget_table(df, s, label, ties, [per_thousand]).select("precision", "recall"))  # one row each
        one = one.select(F.lit(s).alias("model"), "average_precision", F.col("precision").alias("precision_at"), F.col("recall").alias("recall_at"))
        out = one if out is None else out.unionByName(one)
    return out


def fold_summary(folds: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    return folds.groupBy(*by).agg(*[f for m in metrics for f in (F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_std"))])
