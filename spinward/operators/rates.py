"""Failure rates and shares by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinward.functions.columns import wilson
from spinward.operators.distributions import poisson_limits


def afr_table(df: DataFrame, by: Sequence[str], label: Column, days: Column, device: str | None = None) -> DataFrame:
    """Failures per device year, in percent."""
    out = df.groupBy(*by).agg(F.sum(label.cast("long")).alias("failures"), F.sum(days).alias("_days"), *([F.count_distinct(device).alias("devices")] if device else []))
    years = F.col("_days") / 365.0
    return out.withColumn("device_years", years).withColumn("afr_pct", 100.0 * F.try_divide("failures", years)).drop("_days")


def with_poisson_limits(table: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Exact limits of the rate; the table is one of groups, with failures and device_years."""
    spark = table.sparkSession
    k = [r.failures for r in table.select("failures").distinct().collect()]  # one of each count of the report
    limits = spark.createDataFrame([(x, *poisson_limits(spark, x, confidence)) for x in k], "failures long, _lo double, _hi double")
    out = table.join(F.broadcast(limits), "failures")
    return out.withColumn("afr_low", 100 * F.try_divide("_lo", "device_years")).withColumn("afr_high", 100 * F.try_divide("_hi", "device_years")).drop("_lo", "_hi")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values])


def wilson_table(df: DataFrame, by: Sequence[str], label: Column, z: float = 1.96) -> DataFrame:
    out = df.groupBy(*by).agg(F.sum(label.cast("long")).alias("k"), F.count("*").alias("n"))
    p, low, high = wilson(F.col("k"), F.col("n"), z)
    return out.select(*by, "k", "n", p.alias("rate"), low.alias("low"), high.alias("high"))


def reweighted_rate(df: DataFrame, label: Column, negative_weight: float, by: Sequence[str] = ()) -> DataFrame:
    """The rate as before sampling: every negative stands for `negative_weight` of them."""
    positives, negatives = F.sum(label.cast("long")), F.sum((1 - label.cast("long")))
    return df.groupBy(*by).agg(F.try_divide(positives.cast("double"), positives + negative_weight * negatives).alias("rate"))


def lift_table(df: DataFrame, columns: Sequence[str], label: Column) -> DataFrame:
    """How much oftener a value is above 0 among failures; missing values count as not above."""
    share = lambda c, y: F.avg(F.when(label == y, F.coalesce((F.col(c) > 0).cast("double"), F.lit(0.0))))
    wide = df.agg(*[share(c, y).alias(f"_{i}_{y}") for i, c in enumerate(columns) for y in (0, 1)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}_1").alias("share_failed"), F.col(f"_{i}_0").alias("share_healthy")) for i, c in enumerate(columns)])
    out = wide.select(F.explode(cells).alias("_c")).select("_c.*")
    return out.withColumn("lift", F.col("share_failed") / F.greatest("share_healthy", F.lit(1e-6)))


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, missing): the share of nulls of each column."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"_{i}") for i, c in enumerate(columns)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("missing")) for i, c in enumerate(columns)])).alias("_c")).select("_c.*")


def worst_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rates = missing_rates(df, columns)
    return rates.agg(F.max("missing").alias("missing"), F.max_by("feature", F.struct(F.col("missing"), F.col("feature"))).alias("feature"))


def missing_by_group(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    null = lambda c: F.col(c).isNull()
    return df.groupBy(by).agg(*[f for c in columns for f in (F.count_if(null(c)).alias(f"{c}_missing"), F.avg(null(c).cast("double")).alias(f"{c}_missing_share"))])


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias("weighted_mean"))
