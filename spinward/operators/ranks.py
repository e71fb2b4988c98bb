"""Running totals, ranks and exact quantiles without a window that takes all rows, or a group's, into one task.

Rows are first added up by distinct key. The keys of each group go to ranges between approximate quantiles, all found in
one aggregate; windows run within ranges, and totals of ranges give each range its start. Nothing runs until the result
is read, and all groups take the same few stages, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges_of(df: DataFrame, most: int = 1024) -> int:
    """As many ranges as the session has shuffle partitions, within limits."""
    return max(8, min(most, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def running_totals(by_key: DataFrame, key: str, values: Sequence[str], *, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """by_key (a row for each group `by` and key, none null) with `<value>_to`: the sum over the group's keys up to and with this one."""
    ranges = ranges_of(by_key)
    marks = by_key.groupBy(*by).agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_marks"))
    rows = by_key.join(marks, list(by)) if by else by_key.crossJoin(F.broadcast(marks))  # without groups one row of marks
    rows = rows.withColumn("_range", F.size(F.filter("_marks", lambda m: F.col(key) > m))).drop("_marks")
    order = F.col(key).desc() if descending else F.col(key).asc()
    inner = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(v).over(inner).alias(f"{v}_to") for v in values])
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_{v}") for v in values])  # at most `ranges` rows a group
    before = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy(F.col("_range").desc() if descending else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}_start") for v in values])
    rows = rows.join(starts if by else F.broadcast(starts), [*by, "_range"])
    return rows.select(*by_key.columns, *[(F.col(f"{v}_to") + F.col(f"_{v}_start")).alias(f"{v}_to") for v in values])


def average_ranks(counted: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n, rank): the mean of the ranks that rows of a value take, from 1 on; `counted` has rows of n, nulls have no rank."""
    by_value = counted.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum("n").alias("n"))
    return running_totals(by_value, value, ["n"], by=by).select(*by, value, "n", (F.col("n_to") - (F.col("n") - 1) / 2.0).alias("rank"))


def unpivoted(df: DataFrame, columns: Sequence[str], *keep: Column) -> DataFrame:
    """(keep..., feature, x): a row for each value of the columns that is known, as a double."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*[c for c in df.select(*keep).columns], "_c.feature", "_c.x").where("x IS NOT NULL")


def quantiles(long: DataFrame, shares: Sequence[float], *, by: Sequence[str] = ("feature",), value: str = "x") -> DataFrame:
    """(by..., n, q): exact quantiles of each group's values, between neighbours in proportion; null values don't count."""
    counts = long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    curve = running_totals(counts, value, ["n"], by=by)
    whole = counts.groupBy(*by).agg((F.sum("n") - 1).alias("_last"))
    curve = curve.join(whole, list(by)) if by else curve.crossJoin(F.broadcast(whole))  # one row
    ends = []
    for i, q in enumerate(shares):
        at = F.col("_last") * float(q)
        ends += [F.min(F.when(F.col("n_to") > e(at), F.col(value))).alias(f"_{name}{i}") for name, e in (("a", F.floor), ("b", F.ceil))]
    got = curve.groupBy(*by).agg(F.first("_last").alias("_last"), *ends)
    parts = [F.col("_last") * float(q) - F.floor(F.col("_last") * float(q)) for q in shares]
    return got.select(*by, (F.col("_last") + 1).alias("n"), F.array(*[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * part).cast("double") for i, part in enumerate(parts)]).alias("q"))


def top_n(df: DataFrame, n: int | Column, score: str, ties: Sequence[str]) -> DataFrame:
    """The n rows of highest score; ties in order of the columns `ties`. Nothing but the limit goes through one task."""
    return df.orderBy(F.col(score).desc(), *[F.col(t).asc() for t in ties]).limit(n)
