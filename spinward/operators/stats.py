"""Tests and measures of association, each from one or two aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinward.functions.columns import log1p_clip, order_digest
from spinward.operators.distributions import chi2_p_value
from spinward.operators.ranks import average_ranks, quantiles, running_totals, unpivoted
from spinward.session import ship


def chi_square(table: DataFrame, counts: Sequence[str]) -> DataFrame:
    """chi2, dof, cramers_v and n of a contingency table with a row per category; Yates' correction for one degree of freedom."""
    long = table.select(F.monotonically_increasing_id().alias("_row"), *counts)
    cells = long.select("_row", sum((F.col(c) for c in counts), F.lit(0)).alias("_r"), F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(counts)])).alias("_cell")).select("_row", "_r", "_cell.c", "_cell.x").where("_r > 0")
    columns = cells.groupBy("c").agg(F.sum("x").alias("_s")).where("_s > 0")
    whole = cells.agg(F.sum("x").alias("n"), F.count_distinct("_row").alias("rows"))
    shape = columns.agg(F.count("*").alias("cols"))
    each = cells.join(F.broadcast(columns), "c").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(shape))  # one row each
    expected = F.col("_r") * F.col("_s") / F.col("n")
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    gap = F.abs(F.col("x") - expected)
    gap = F.when(dof == 1, F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0))).otherwise(gap)
    out = each.groupBy("n", "rows", "cols").agg(F.sum(F.try_divide(gap * gap, expected)).alias("chi2"))
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.least("rows", "cols") - 1)))
    return out.select("chi2", dof.cast("long").alias("dof"), v.alias("cramers_v"), F.col("n").cast("long").alias("n"))


def chi_square_p(result: DataFrame) -> float:
    r = result.first()
    return chi2_p_value(result.sparkSession, r.chi2, r.dof)


def odds_ratios(df: DataFrame, columns: Sequence[str], label: Column, z: float = 1.96) -> DataFrame:
    """Odds of failure with a value above 0 against 0, 0.5 added to each count; (feature, a, b, c, d, odds_ratio, low, high)."""
    rules = {"a": lambda c: (F.col(c) > 0) & (label == 1), "b": lambda c: (F.col(c) > 0) & (label == 0), "c": lambda c: (F.col(c) == 0) & (label == 1), "d": lambda c: (F.col(c) == 0) & (label == 0)}
    wide = df.agg(*[F.count_if(rule(c)).alias(f"_{k}{i}") for i, c in enumerate(columns) for k, rule in rules.items()])
    out = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"_{k}{i}").alias(k) for k in rules]) for i, c in enumerate(columns)])).alias("_c")).select("_c.*")
    a, b, c, d = (F.col(k) + 0.5 for k in "abcd")
    ratio, se = (a * d) / (b * c), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return out.select("*", ratio.alias("odds_ratio"), F.exp(F.log(ratio) - z * se).alias("low"), F.exp(F.log(ratio) + z * se).alias("high"))


def auc_of(df: DataFrame, score: str, label: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc, positives, negatives): the rank-sum area, ties half; null without both labels.

    Rows are added up by distinct score first. By group, ranks run within each group's scores; rows without one don't count.
    """
    known = F.col(score).isNotNull()
    for g in by:
        known = known & F.col(g).isNotNull()
    counts = df.where(known).groupBy(*by, score).agg(F.sum(label.cast("long")).alias("p"), F.sum(1 - label.cast("long")).alias("q"))
    counts = running_totals(counts, score, ["q"], by=by)
    won = F.sum(F.col("p") * (F.col("q_to") - F.col("q") / 2.0))
    positives, negatives = F.sum("p"), F.sum("q")
    return counts.groupBy(*by).agg(F.try_divide(won, (positives * negatives).cast("double")).alias("auc"), positives.alias("positives"), negatives.alias("negatives"))


def oriented(auc: Column) -> Column:
    """The better of both directions; 0.5 where there is none."""
    return F.coalesce(F.greatest(auc, 1 - auc), F.lit(0.5))


def oriented_aucs(df: DataFrame, features: Sequence[str], label: Column) -> DataFrame:
    """(feature, auc) of all features in one pass over the rows; 0.5 where one has no value."""
    long = unpivoted(df, features, label.alias("_y"))
    names = df.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(features)], "feature string")
    return names.join(F.broadcast(auc_of(long, "x", F.col("_y"), ["feature"])), "feature", "left").select("feature", oriented(F.col("auc")).alias("auc"))  # a row for each feature


def within_group_auc(df: DataFrame, score: str, label: Column, group: str, *, least_positives: int = 50, leave_out: str = "Other") -> DataFrame:
    """The mean of the groups' oriented areas, weighed by their rows."""
    each = auc_of(df.where(F.col(group) != leave_out), score, label, [group]).where(F.col("positives") >= least_positives)
    weight = F.col("positives") + F.col("negatives")
    return each.agg(F.try_divide(F.sum(oriented(F.col("auc")) * weight), F.sum(weight).cast("double")).alias("auc"), F.count("*").alias("groups"))


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rho, n) of each pair of columns, over the rows where both are known; all pairs in the same few stages."""
    double = {c: F.col(c).cast("double") for c in columns}
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), double[a].alias("x"), double[b].alias("y")) for a, b in combinations(columns, 2)])
    pair = ["a", "b"]
    both = df.select(F.explode(cells).alias("_c")).select("_c.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy(*pair, "x", "y").agg(F.count("*").alias("n"))
    rx, ry = (average_ranks(both, v, pair).select(*pair, v, F.col("rank").alias(f"r{v}")) for v in ("x", "y"))
    sums = {"sx": F.col("rx"), "sy": F.col("ry"), "sxx": F.col("rx") ** 2, "syy": F.col("ry") ** 2, "sxy": F.col("rx") * F.col("ry")}
    r = both.join(rx, [*pair, "x"]).join(ry, [*pair, "y"]).groupBy(*pair).agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * e).alias(k) for k, e in sums.items()])
    rho = F.try_divide(F.expr("n * sxy - sx * sy"), F.sqrt(F.expr("n * sxx - sx * sx")) * F.sqrt(F.expr("n * syy - sy * sy")))
    names = df.sparkSession.createDataFrame(list(combinations(columns, 2)), "a string, b string")
    return names.join(F.broadcast(r), pair, "left").select("a", "b", rho.alias("rho"), F.coalesce("n", F.lit(0)).alias("n"))  # a row for each pair


def redundant_pairs(rho: DataFrame, least: float = 0.6, top: int = 12) -> DataFrame:
    return rho.where(F.abs("rho") >= least).orderBy(F.abs("rho").desc(), "a", "b").limit(top)


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """(h, dof, n), corrected for ties; kruskal_p has the p-value of the one row."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    cells = rows.groupBy(value, group).agg(F.count("*").alias("n"))
    ranks = average_ranks(cells, value).drop("n")
    sums = cells.join(ranks, value).groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    total = sums.agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), (F.count("*") - 1).alias("dof"))
    ties = cells.groupBy(value).agg(F.sum("n").cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    h = F.expr("12.0 / (n * (n + 1.0)) * s - 3 * (n + 1.0)") / (1 - F.col("ties") / F.expr("cast(n as double) * n * n - n"))
    return total.crossJoin(ties).select(h.alias("h"), "dof", "n")  # one row each


def kruskal_p(result: DataFrame) -> float:
    r = result.first()
    return chi2_p_value(result.sparkSession, r.h, r.dof)


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population skewness and excess kurtosis, the largest |z| (sample deviation) and the share of zeros; one aggregate."""
    stats = {
        "skew": F.skewness, "kurtosis": F.kurtosis, "zero_share": lambda x: F.avg((x == 0).cast("double")),
        "max_abs_z": lambda x: F.greatest((F.max(x) - F.avg(x)) / F.stddev_samp(x), (F.avg(x) - F.min(x)) / F.stddev_samp(x)),
    }
    wide = df.agg(*[f(F.col(c)).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in stats.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{k}_{i}").alias(k) for k in ("skew", "kurtosis", "max_abs_z", "zero_share")]) for i, c in enumerate(columns)])
    return wide.select(F.explode(cells).alias("_c")).select("_c.*")


def transform_table(df: DataFrame, columns: Sequence[str], label: Column) -> DataFrame:
    """Skewness, kurtosis and oriented area of each column, as it is and by log(1 + x)."""
    forms = {f"{name} {c}": x.cast("double") for c in columns for name, x in (("raw", F.col(c)), ("log1p", log1p_clip(F.col(c))))}
    rows = df.select(*[x.alias(n) for n, x in forms.items()], label.alias("_y"))
    both = moments(rows, list(forms)).join(F.broadcast(oriented_aucs(rows, list(forms), F.col("_y"))), "feature")  # a row for each form
    form, name = F.split("feature", " ", 2)[0], F.split("feature", " ", 2)[1]
    return both.select(name.alias("feature"), form.alias("form"), "skew", "kurtosis", "auc")


def signal_table(df: DataFrame, pairs: Sequence[tuple[str, str]], label: Column) -> DataFrame:
    """For each (level, change) pair of columns their oriented areas and how much oftener failures have a change above 0."""
    from spinward.operators.rates import lift_table

    lift = lift_table(df, [d for _, d in pairs], label).withColumnRenamed("feature", "change")
    names = df.sparkSession.createDataFrame(list(pairs), "level string, change string")
    auc = oriented_aucs(df, [c for p in pairs for c in p], label)
    level = auc.select(F.col("feature").alias("level"), F.col("auc").alias("auc_level"))
    change = auc.select(F.col("feature").alias("change"), F.col("auc").alias("auc_change"))
    return names.join(F.broadcast(level), "level").join(F.broadcast(change), "change").join(F.broadcast(lift), "change").select("level", "change", "auc_level", "auc_change", "share_failed", "share_healthy", "lift")


def family_scores(scores: DataFrame, score: str = "mi") -> DataFrame:
    """(family, total, mean, greatest) of features' scores by what their names say: normalized, raw or metadata."""
    name = F.col("feature")
    family = F.when(F.contains(name, F.lit("_normalized_")), "normalized").when(F.contains(name, F.lit("_raw_")), "raw").otherwise("metadata")
    return scores.groupBy(family.alias("family")).agg(F.sum(score).alias("total"), F.avg(score).alias("mean"), F.max(score).alias("greatest"))


def without_constant_odds(odds: DataFrame, limit: float = 0.95) -> DataFrame:
    """The odds table, without ratio and limits where more than `limit` of the healthy rows are above 0: they say nothing there."""
    always = F.try_divide(F.col("b"), F.col("b") + F.col("d")) > limit
    return odds.select(*[F.when(~F.coalesce(always, F.lit(False)), F.col(c)).alias(c) if c in ("odds_ratio", "low", "high") else F.col(c) for c in odds.columns])


def distinct_levels(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """How many values the raw and the normalised form of a sensor take, and the ratio; the mode of the latter and its share."""
    out = None
    for a, b in pairs:
        one = df.agg(F.count_distinct(a).alias("raw_levels"), F.count_distinct(b).alias("levels"))
        top = df.where(F.col(b).isNotNull()).groupBy(b).agg(F.count("*").alias("n"))
        mode = top.agg(F.max_by(F.col(b).cast("double"), F.struct(F.col("n"), -F.col(b))).alias("mode"), (F.max("n") / F.sum("n")).alias("mode_share"))
        one = one.crossJoin(mode).select(F.lit(a).alias("raw"), F.lit(b).alias("other"), "raw_levels", "levels", F.try_divide(F.col("raw_levels").cast("double"), F.col("levels")).alias("ratio"), "mode", "mode_share")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, n, density) of equal bins closed on the left, the last one on both sides; empty bins have no row."""
    width = (high - low) / bins
    rows = df.where(F.col(value).between(low, high)).withColumn("bin", F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int"))
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(1)))  # at most `bins` rows a group
    return counts.withColumn("density", F.col("n") / (total * width))


def ecdf(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, value, n, share_to): the share of a group's values above 0 that are this or less, a row for each value."""
    counts = df.where((F.col(value) > 0) & F.col(by).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    whole = counts.groupBy(by).agg(F.sum("n").alias("_all"))
    return running_totals(counts, value, ["n"], by=[by]).join(whole, by).select(by, value, "n", (F.col("n_to") / F.col("_all")).alias("share_to"))


def group_medians(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Exact medians of the columns in each group, null where a group has no value."""
    found = quantiles(unpivoted(df, columns, F.col(by)).where(F.col(by).isNotNull()), [0.5], by=[by, "feature"])
    wide = found.groupBy(by).agg(*[F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(f"{c}_median") for c in columns])
    return df.select(by).distinct().join(wide, by, "left")


def stratified_sample(df: DataFrame, by: str, n: int, keys: Sequence[str], seed: int = 7) -> DataFrame:
    """n rows of each stratum, those of least digest; the same in every run.

    Digests are counted by prefix, and only rows up to the prefix where a stratum's limit falls are ranked: about n of them.
    """
    rows = df.withColumn("_digest", order_digest(seed, *keys)).withColumn("_prefix", F.substring("_digest", 1, 4))
    counts = rows.groupBy(by, "_prefix").agg(F.count("*").alias("_n"))  # 65,536 rows a stratum at most
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_prefix")) - F.col("_n")
    edge = counts.withColumn("_before", before).where(F.col("_before") < n).groupBy(by).agg(F.max("_prefix").alias("_edge"))
    near = rows.join(edge.withColumnRenamed(by, "_by"), rows[by].eqNullSafe(F.col("_by"))).where("_prefix <= _edge").drop("_by", "_edge", "_prefix")
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_digest", *keys))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_digest", "_rank")


def mutual_information(df: DataFrame, features: Sequence[str], label: str, *, per_class: int = 25_000, keys: Sequence[str], k: int = 5, seed: int = 1) -> DataFrame:
    """(feature, mi) in nats by nearest neighbours within a class (k of them), nulls as the median, over a stratified sample.

    The sample is bounded, as the method's definition asks; a feature's values, 2 * per_class of them, meet in one task.
    """
    import numpy as np
    import pandas as pd

    ship(df.sparkSession)
    some = stratified_sample(df, label, per_class, keys, seed)
    medians = {r.feature: r.q[0] for r in quantiles(unpivoted(some, features), [0.5]).collect()}  # a row for each feature
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(float(medians.get(c) or 0.0))).alias("x")) for c in features])
    long = some.select(F.col(label).cast("int").alias("y"), F.explode(cells).alias("_c")).select("_c.feature", "_c.x", "y")

    def digamma(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        x = x.astype(float).copy()
        for _ in range(6):
            low = x < 6
            out[low] -= 1 / x[low]
            x[low] += 1
        return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)

    def estimate(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        x = x / (x.std() or 1.0)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        own, near, kept = [], [], np.zeros(len(x), bool)
        for c in np.unique(y):
            at = np.flatnonzero(y == c)
            n = len(at)
            if n < 2:
                continue
            kk, v = min(k, n - 1), x[at]
            wide = np.full((n, 2 * kk), np.inf)
            for s in range(1, kk + 1):
                wide[s:, s - 1] = v[s:] - v[:-s]
                wide[:-s, kk + s - 1] = v[s:] - v[:-s]
            radius = np.sort(wide, 1)[:, kk - 1] * (1 - 1e-10)  # just short of the k-th neighbour
            kept[at] = True
            own.append((at, np.full(n, n), np.full(n, kk), radius))
        if not own:
            return pd.DataFrame({"feature": [rows["feature"].iloc[0]], "mi": [0.0]})
        at = np.concatenate([o[0] for o in own])
        size, kk, radius = (np.concatenate([o[i] for o in own]) for i in (1, 2, 3))
        v = x[kept]
        near = np.searchsorted(v, x[at] + radius, "right") - np.searchsorted(v, x[at] - radius, "left")
        mi = digamma(np.array([kept.sum()]))[0] + digamma(kk).mean() - digamma(size).mean() - digamma(near).mean()
        return pd.DataFrame({"feature": [rows["feature"].iloc[0]], "mi": [max(0.0, float(mi))]})

    return long.groupBy("feature").applyInPandas(estimate, "feature string, mi double")
