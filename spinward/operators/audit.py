"""Checks of a labelled table: (check, result, evidence), a row each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spinward.operators.ranks import quantiles


def failure_is_last_window(windows: DataFrame) -> DataFrame:
    """The share of failed windows that are their device's last one."""
    last = F.max("window").over(Window.partitionBy("serial_number"))
    return windows.withColumn("_last", last).where("failed_in_window = 1").agg(F.count("*").alias("failures"), F.try_divide(F.count_if(F.col("window") == F.col("_last")).cast("double"), F.count("*")).alias("last_share"))


def audit(rows: DataFrame, windows: DataFrame, *, neg_ratio: float, ranges: dict[str, tuple[float, float]], counters: Sequence[str], hours: tuple[str, int] | None = None, most_missing: float = 0.05) -> DataFrame:
    """Unique keys, splits disjoint in rows and in time, the sampling ratio, failures last, plausible ranges, hours that follow
    the calendar (a delta of hours, for windows of so many days' span), missing values, counters not negative.

    Both tables are held while they are read, five times in all; the report of some dozen rows is made on the driver.
    """
    splits = ("train", "calib", "test")
    rows, windows = rows.persist(), windows.select("serial_number", "window", "failed_in_window").persist()
    out: list[tuple] = []

    def check(name: str, good: bool | None, evidence: float | None) -> None:
        out.append((name, "PASS" if good else "REVIEW", None if evidence is None else round(float(evidence), 6)))

    try:
        of = {s: F.col("split") == s for s in splits}
        keys = rows.groupBy("serial_number", "window").agg(*[F.count_if(x).alias(s) for s, x in of.items()])
        k = keys.agg(*[F.coalesce(F.sum(F.greatest(F.col(s) - 1, F.lit(0))), F.lit(0)).alias(s) for s in splits], F.count_if(sum(((F.col(s) > 0).cast("int") for s in splits), F.lit(0)) > 1).alias("shared")).first()
        low, high = (lambda s: F.min(F.when(of[s], F.col("window")))), (lambda s: F.max(F.when(of[s], F.col("window"))))
        label = F.col("label")
        w = rows.agg(
            *[f for s in splits for f in (low(s).alias(f"low_{s}"), high(s).alias(f"high_{s}"))],
            F.count_if(of["train"] & (label == 0)).alias("neg"),
            F.count_if(of["train"] & (label == 1)).alias("pos"),
            F.bround(F.count_if(of["train"] & (label == 1)) * F.lit(float(neg_ratio))).alias("want"),
            *[F.avg(F.col(c).between(*r).cast("double")).alias(f"in_{i}") for i, (c, r) in enumerate(ranges.items())],
            F.greatest(*[F.avg(F.col(c).isNull().cast("double")) for c in counters], F.lit(0.0)).alias("missing"),
            sum((F.count_if(F.col(c) < 0) for c in counters), F.lit(0)).alias("negative"),
        ).first()
        last = rows.groupBy("split", "serial_number").agg(F.sum(label.cast("long")).alias("n"), F.max_by(label.cast("long"), F.col("window")).alias("hit")).groupBy("split").agg(F.try_divide(F.sum("hit").cast("double"), F.sum("n")).alias("share"))
        share = {r.split: r.share for r in last.collect()}
        for s in splits:
            check(f"unique keys in {s}", k[s] == 0, k[s])
        check("splits share no row", k.shared == 0, k.shared)
        ends = [(w[f"high_{a}"], w[f"low_{b}"]) for a, b in zip(splits, splits[1:], strict=False)]
        gap = None if any(None in e for e in ends) else min(b - a for a, b in ends)
        check("splits are apart in time", gap is not None and gap > 0, gap)
        check("negatives per positive", w.neg == w.want, w.neg / w.pos if w.pos else None)
        f = failure_is_last_window(windows).first().last_share
        check("failures are last windows", f is not None and f > 0.995, f)
        for s in splits[:2]:
            check(f"labels are last in {s}", share.get(s) is not None and share[s] > 0.995, share.get(s))
        for i, c in enumerate(ranges):
            check(f"{c} in range", w[f"in_{i}"] == 1, w[f"in_{i}"])
        if hours:
            full = rows.where(of["train"] & (F.col("days_span") == hours[1])).select((F.col(hours[0]) / (24.0 * hours[1])).alias("x"))
            q = quantiles(full, [0.5], by=()).first()
            m = q.q[0] if q and q.q else None
            check("hours follow the calendar", m is not None and 0.95 < m < 1.05, m)
        check("most missing", w.missing < most_missing, w.missing)
        check("counters not negative", w.negative == 0, w.negative)
    finally:
        rows.unpersist()
        windows.unpersist()
    return rows.sparkSession.createDataFrame(out, "check string, result string, evidence double")
