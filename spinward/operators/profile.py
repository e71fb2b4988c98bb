"""What columns a drifting source has, how well they are filled, and which can be relied on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinward.functions.columns import has_marker, quarter_order
from spinward.operators.ranks import quantiles, unpivoted


def non_null_counts(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, non_null_rows, total_rows): one aggregate over all columns, then turned into rows."""
    columns = list(columns or [c for c in df.columns if c not in by])
    wide = df.groupBy(*by).agg(F.count("*").alias("_total"), *[F.count(f"`{c}`").alias(f"_n{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("non_null_rows")) for i, c in enumerate(columns)])
    return wide.select(*by, F.explode(cells).alias("_cell"), F.col("_total").alias("total_rows")).select(*by, "_cell.column", "_cell.non_null_rows", "total_rows")


def coverage(counts: DataFrame, *, sensor_prefix: str = "smart_") -> DataFrame:
    """Adds counts of parts up; percentages to two digits, half to even. Sensors come last, the best filled first."""
    total = counts.groupBy("column").agg(F.sum("non_null_rows").alias("non_null_rows"), F.sum("total_rows").alias("total_rows"))
    pct = F.bround(100.0 * F.col("non_null_rows") / F.nullif("total_rows", F.lit(0)), 2)
    out = total.select("column", "non_null_rows", "total_rows", pct.alias("coverage_pct"), F.startswith(F.col("column"), F.lit(sensor_prefix)).alias("is_smart"))
    return out.orderBy("is_smart", F.desc("coverage_pct"), "column")


def part_coverage(counts: DataFrame, part: str = "quarter", *, sensor_prefix: str = "smart_") -> DataFrame:
    """The coverage of every column in every part, in order of quarters."""
    pct = F.bround(100.0 * F.col("non_null_rows") / F.nullif("total_rows", F.lit(0)), 2)
    out = counts.select(part, "column", "non_null_rows", "total_rows", pct.alias("coverage_pct"), F.startswith(F.col("column"), F.lit(sensor_prefix)).alias("is_smart"))
    return out.orderBy(quarter_order(F.col(part)), "is_smart", F.desc("coverage_pct"), "column")


def presence(headers: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Columns that some part lacks: (column, quarters_present, missing_from). headers: (quarter, column) of the files' headers."""
    every = F.array(*[F.lit(p) for p in sorted(parts)])
    seen = headers.groupBy("column").agg(F.count_distinct("quarter").alias("quarters_present"), F.collect_set("quarter").alias("_in"))  # as many as there are parts
    out = seen.where(F.col("quarters_present") < len(parts))
    return out.select("column", "quarters_present", F.array_join(F.array_except(every, "_in"), " ").alias("missing_from"))


def locked_columns(cover: DataFrame, headers: DataFrame, parts: Sequence[str], *, required: Sequence[str], min_coverage: float = 90.0) -> DataFrame:
    """Columns of every part that are filled well enough; required ones need to be present only."""
    everywhere = headers.groupBy("column").agg(F.count_distinct("quarter").alias("_n")).where(F.col("_n") == len(parts)).select("column")
    return cover.join(everywhere, "column", "left_semi").where(F.col("column").isin(list(required)) | (F.col("is_smart") & (F.col("coverage_pct") >= min_coverage))).select("column")


def coverage_counters(cover: DataFrame) -> DataFrame:
    pct = F.col("coverage_pct")
    return cover.agg(F.count("*").alias("columns"), F.count_if(pct > 90).alias("over_90"), F.count_if(pct > 50).alias("over_50"), F.count_if(pct < 1).alias("under_1"))


def model_counts(df: DataFrame, model: str = "model") -> DataFrame:
    return df.groupBy(model).agg(F.count("*").alias("drive_days")).orderBy(F.desc("drive_days"), model)


def marked_share(df: DataFrame, model: Column, markers: Sequence[str]) -> DataFrame:
    """How many rows are of models with one of the markers."""
    hit = F.count_if(has_marker(model, markers))
    return df.agg(F.count("*").alias("n_rows"), hit.alias("marked"), F.round(100.0 * hit / F.nullif(F.count("*"), F.lit(0)), 6).alias("marked_pct"))


def quarter_report(df: DataFrame, part: str, *, dropped: Column, failed: Column) -> DataFrame:
    """Rows in, kept, dropped (and their share) and failures of each part, in order of quarters, with a last row `TOTAL`."""
    out = df.rollup(part).agg(F.count("*").alias("rows_in"), F.count_if(~dropped).alias("rows_kept"), F.count_if(dropped).alias("rows_dropped"), F.count_if(~dropped & failed).alias("failures"), F.grouping(part).alias("_all"))
    name = F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(part))
    pct = F.round(100.0 * F.col("rows_dropped") / F.nullif("rows_in", F.lit(0)), 3)
    rows = out.orderBy("_all", quarter_order(F.col(part)))
    return rows.select(name.alias(part), "rows_in", "rows_kept", "rows_dropped", pct.alias("dropped_pct"), "failures", F.floor(F.try_divide("rows_kept", "failures")).cast("long").alias("one_in"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, least, exact quartiles and greatest of each column, a row each."""
    long = unpivoted(df, columns)
    stats = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    both = stats.join(quantiles(long, [0.25, 0.5, 0.75]), "feature")
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = names.join(F.broadcast(both), F.col("column") == F.col("feature"), "left")  # a row for each column
    return out.select("column", F.coalesce("n", F.lit(0)).cast("double").alias("count"), "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def feature_catalogue(df: DataFrame) -> DataFrame:
    """(feature, kind, smart_id, stat, dtype) of every column, from names and types."""
    rows = df.sparkSession.createDataFrame(df.dtypes, "feature string, dtype string")
    pattern = r"^smart_(\d+)_(raw|normalized)_(first|last|delta)$"
    part = lambda i: F.nullif(F.regexp_extract("feature", pattern, i), F.lit(""))
    return rows.select("feature", part(2).alias("kind"), part(1).cast("int").alias("smart_id"), part(3).alias("stat"), "dtype")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows only one of two tables has, counting repeats: both 0 if they are equal."""
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))  # one row each


def overlap(df: DataFrame, key: str, group: str, groups: Sequence[str]) -> DataFrame:
    """How many keys each pair of groups shares, and how many of the last are in none of the others."""
    has = df.groupBy(key).agg(*[F.max((F.col(group) == g).cast("int")).alias(g) for g in groups])
    pairs = [F.sum(F.col(a) * F.col(b)).cast("long").alias(f"{a}_{b}") for i, a in enumerate(groups) for b in groups[i + 1 :]]
    last, first = groups[-1], groups[0]
    return has.agg(*pairs, F.sum(F.col(last) * (1 - F.col(first))).cast("long").alias(f"{last}_not_{first}"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of their key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
