"""Model inputs: derived columns, imputation, scaling, one-hot columns, weights and folds."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spinward.functions.columns import VENDORS, capacity_tb, known_capacity, order_digest, signed_log, vendor
from spinward.operators.ranks import quantiles, unpivoted

#: SMART attributes of the feature matrix: three statistics each. Fixed values.
FEATURE_SMART_IDS = (1, 3, 5, 7, 10, 12, 192, 193, 194, 197, 198, 199)
#: And of the baseline, all but 4. Fixed values.
BASELINE_SMART_IDS = (1, 3, 5, 7, 9, 10, 12, 192, 193, 194, 197, 198, 199)
STATS = ("first", "last", "delta")
NUMERIC = tuple(f"smart_{i}_raw_{s}" for i in FEATURE_SMART_IDS for s in STATS) + ("smart_9_raw_last", "capacity_tb", "days_observed")


BASELINE = tuple(f"smart_{i}_raw_{s}" for i in BASELINE_SMART_IDS for s in STATS)


def feature_matrix(rows: DataFrame, numeric: Sequence[str] = NUMERIC, *, keep: Sequence[str] = ("serial_number", "window", "label")) -> DataFrame:
    """Keys, label, numeric inputs and the vendor; capacities in whole terabytes, unknown ones null."""
    out = rows.withColumn("capacity_tb", capacity_tb(F.col("capacity_bytes"))).withColumn("vendor", vendor(F.coalesce("model", F.lit(""))))
    return out.select(*keep, *[F.col(c).cast("double").alias(c) for c in numeric], "vendor")


def baseline_matrix(rows: DataFrame, sensors: Sequence[str] = BASELINE, *, keep: Sequence[str] = ("serial_number", "window", "label")) -> DataFrame:
    """Keys, label, raw sensors, capacity in bytes, days and the vendor."""
    numeric = list(sensors)
    out = rows.withColumn("capacity_bytes", known_capacity(F.col("capacity_bytes"))).withColumn("vendor", vendor(F.coalesce("model", F.lit(""))))
    return out.select(*keep, *[F.col(c).cast("double").alias(c) for c in (*numeric, "capacity_bytes", "days_observed", "days_span")], "vendor")


@dataclass
class Preparation:
    """Fitted on training rows: exact medians, which columns had nulls, means and population deviations."""

    columns: list[str]
    log: bool = True
    scale: bool = True
    medians: dict[str, float] = field(default_factory=dict)
    with_nulls: list[str] = field(default_factory=list)
    mean: dict[str, float] = field(default_factory=dict)
    deviation: dict[str, float] = field(default_factory=dict)

    def fit(self, rows: DataFrame) -> Preparation:
        got = rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(self.columns)]).first()
        known = {r.feature: r.q[0] for r in quantiles(unpivoted(rows, self.columns), [0.5]).collect()}  # a row for each column
        self.medians = {c: float(known.get(c) or 0.0) for c in self.columns}
        self.with_nulls = [c for i, c in enumerate(self.columns) if got[f"n{i}"]]
        if self.scale:
            filled = rows.select(*[x.alias(n) for n, x in self._filled().items()])
            got = filled.agg(*[f for i, n in enumerate(filled.columns) for f in (F.avg(n).alias(f"a{i}"), F.stddev_pop(n).alias(f"s{i}"))]).first()
            for i, n in enumerate(filled.columns):
                self.mean[n], self.deviation[n] = float(got[f"a{i}"] or 0.0), float(got[f"s{i}"] or 0.0) or 1.0
        return self

    def _filled(self) -> dict[str, Column]:
        out = {c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.columns}
        out |= {f"{c}_missing": F.col(c).isNull().cast("double") for c in self.with_nulls}
        return {n: signed_log(x) for n, x in out.items()} if self.log else out

    def save(self, spark: SparkSession, path: str) -> None:
        """As one line of JSON, on any path that Spark can write."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preparation:
        return cls(**json.loads(spark.read.text(path).first().value))

    def outputs(self) -> list[str]:
        return [*self.columns, *[f"{c}_missing" for c in self.with_nulls]]

    def apply(self, rows: DataFrame) -> DataFrame:
        made = {n: (x - self.mean[n]) / self.deviation[n] if self.scale else x for n, x in self._filled().items()}
        return rows.select(*[c for c in rows.columns if c not in made], *[x.alias(n) for n, x in made.items()])


def one_hot(rows: DataFrame, column: str, categories: Sequence[str] = VENDORS) -> DataFrame:
    """A 0/1 column for each category; unknown values have only zeros."""
    return rows.select("*", *[F.coalesce((F.col(column) == c).cast("double"), F.lit(0.0)).alias(f"{column}_{c}") for c in categories])


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """weight = n / (2 * rows of the label)."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    whole = n.agg(F.sum("_n").alias("_all"))
    weights = n.crossJoin(whole).select(label, (F.col("_all") / (2.0 * F.col("_n"))).alias("weight"))  # two rows by one
    return rows.join(F.broadcast(weights), label)


def time_folds(windows: Sequence[int], n_folds: int = 4, gap: int = 1) -> list[tuple[list[int], list[int]]]:
    """(training, validation) windows: validation runs through successive parts, training through what ends `gap` before."""
    windows = sorted(set(windows))
    parts, at = [], 0
    for i in range(n_folds + 1):
        size = len(windows) // (n_folds + 1) + (i < len(windows) % (n_folds + 1))
        parts.append(windows[at : at + size])
        at += size
    return [([w for w in windows if w < min(valid) - gap], valid) for valid in parts[1:] if valid]


def fold_table(rows: DataFrame, n_folds: int = 4, gap: int = 1) -> DataFrame:
    """(fold, part, window) of the windows in rows; windows are a short list."""
    windows = [r.window for r in rows.select("window").distinct().collect()]
    out = [(i, part, w) for i, fold in enumerate(time_folds(windows, n_folds, gap)) for part, ws in zip(("train", "valid"), fold, strict=True) for w in ws]
    return rows.sparkSession.createDataFrame(out, "fold int, part string, window int")


def manual_fold(rows: DataFrame, last_train: int, first_valid: int) -> tuple[DataFrame, DataFrame]:
    """Training rows up to one window, validation rows from another on; windows between them are the gap."""
    if first_valid <= last_train:
        raise ValueError("validation starts after training")
    return rows.where(F.col("window") <= last_train), rows.where(F.col("window") >= first_valid)


def group_halves(rows: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """Half A or B by group: A has the groups of least digest, as many as B or one more. Rows without a group are of B.

    Groups are counted by prefix of their digest; only those of the prefix where the middle falls are ranked.
    """
    digest = F.when(F.col(group).isNotNull(), order_digest(seed, group))
    groups = rows.where(F.col(group).isNotNull()).select(digest.alias("_digest")).distinct()
    prefix = F.substring("_digest", 1, 4).alias("_prefix")
    counts = groups.groupBy(prefix).agg(F.count("*").alias("n"))  # 65,536 rows at most
    all_, by = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("_prefix")
    half = F.ceil(F.sum("n").over(all_) / 2).alias("_half")
    marks = counts.select("_prefix", "n", half, (F.sum("n").over(by) - F.col("n")).alias("_before"))
    edge = marks.where("_before < _half AND _before + n >= _half").select(F.col("_prefix").alias("_edge"), (F.col("_half") - F.col("_before")).alias("_left"))
    near = groups.select("_digest", prefix).join(F.broadcast(edge), F.col("_prefix") == F.col("_edge"))  # one row
    rank = F.row_number().over(Window.partitionBy("_edge").orderBy("_digest"))
    middle = near.withColumn("_rank", rank).where("_rank = _left").select(F.col("_digest").alias("_middle"))
    out = rows.join(F.broadcast(middle), F.lit(True), "left")  # one row, or none without groups
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(digest <= F.col("_middle"), "A").otherwise("B").alias("half"))
