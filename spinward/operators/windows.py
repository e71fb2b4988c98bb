"""From snapshots of devices to a labelled table of calendar windows: grid, aggregate, label, split, sample."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spinward.functions.columns import ID_COLUMNS, grid_index, order_digest


@dataclass(frozen=True)
class Grid:
    """Calendar windows, the limits of the three splits and how training rows are sampled."""

    epoch: str = "2023-01-01"
    window_days: int = 30
    train_end: str = "2024-11-01"
    test_start: str = "2025-01-01"
    neg_ratio: float = 20.0
    min_days: int = 2
    seed: int = 42

    def __post_init__(self) -> None:
        if not self.epoch < self.train_end < self.test_start:
            raise ValueError("epoch < train_end < test_start must hold")
        if self.window_days < 1:
            raise ValueError("a window has a day at least")


def sensors_of(daily: DataFrame) -> list[str]:
    return [c for c in daily.columns if c not in ID_COLUMNS]


def first_of(value: str, by: Column | str) -> Column:
    """The first value that is not null."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(by) if isinstance(by, str) else by))


def last_of(value: str, by: Column | str) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(by) if isinstance(by, str) else by))


def with_window(daily: DataFrame, grid: Grid) -> DataFrame:
    return daily.withColumn("window", grid_index(F.col("date"), grid.epoch, grid.window_days))


def model_names(daily: DataFrame, most: int = 10_000) -> list[str] | None:
    """The models of a fleet, from a scan of one column; None if there are more than `most`."""
    names = [r.model for r in daily.where("model IS NOT NULL").select("model").distinct().limit(most + 1).collect()]
    return names if len(names) <= most else None


def aggregate_windows(daily: DataFrame, grid: Grid, *, co_partition: bool | None = None, models: Sequence[str] | None = None) -> DataFrame:
    """A row for each device and window. Dealing rows out by device first serves all later steps with one exchange.

    With `models`, the names that occur, rows carry a number for the model and get its name back at the end: then all
    buffers have a fixed size, and the aggregation is hashed and compiled instead of sorted. By default rows are dealt out
    first only where it is sorted; hashed aggregation combines rows before its exchange, which measures faster.
    """
    sensors = sensors_of(daily)
    co_partition = models is None if co_partition is None else co_partition
    if models is not None:
        code = F.xxhash64("model")
        daily = daily.withColumn("model", F.when(F.col("model").isNotNull(), code))
        conf = daily.sparkSession.conf
        conf.set("spark.sql.codegen.maxFields", str(max(int(conf.get("spark.sql.codegen.maxFields")), 4 * len(sensors) + 100)))
    rows = daily.repartition("serial_number") if co_partition else daily
    ends = [f(s, "date").alias(f"{s}_{name}") for s in sensors for name, f in (("first", first_of), ("last", last_of))]
    out = with_window(rows, grid).groupBy("serial_number", "window").agg(
        *ends,
        F.min("date").alias("window_first_date"),
        F.max("date").alias("window_last_date"),
        F.count("date").alias("days_observed"),
        last_of("capacity_bytes", "date").alias("capacity_bytes"),
        last_of("model", "date").alias("model"),
        F.max("failure").alias("failed_in_window"),
    )
    span = F.datediff("window_last_date", "window_first_date").cast("short").alias("days_span")
    deltas = [(F.col(f"{s}_last") - F.col(f"{s}_first")).alias(f"{s}_delta") for s in sensors]
    if models is not None:
        names = daily.sparkSession.createDataFrame([(m,) for m in models], "name string").withColumn("code", F.xxhash64("name"))
        columns = out.columns
        out = out.join(F.broadcast(names), out["model"] == names["code"], "left").select(*[F.col("name").alias(c) if c == "model" else out[c] for c in columns])
    head = [c for c in out.columns if c != "failed_in_window"]
    return out.select(*head, span, *deltas, "failed_in_window")


def label_windows(windows: DataFrame) -> DataFrame:
    """Label 1 if the device fails in the next window; windows without the next one are left out.

    drive_days_to_date adds up the days of the windows that stay, up to and with this one.
    """
    by_device = Window.partitionBy("serial_number").orderBy("window")
    ahead = windows.select("*", F.lead("window").over(by_device).alias("_next"), F.lead("failed_in_window").over(by_device).cast("byte").alias("label"))
    kept = ahead.where(F.col("_next") == F.col("window") + 1)
    so_far = F.sum("days_observed").over(by_device.rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("drive_days_to_date", so_far).drop("_next", "failed_in_window")


def label_by_join(windows: DataFrame) -> DataFrame:
    """The labels of label_windows by a join with the next window, as a cross-check: (serial_number, window, label)."""
    after = windows.select("serial_number", (F.col("window") - 1).alias("window"), F.col("failed_in_window").cast("byte").alias("label"))
    return windows.select("serial_number", "window").join(after, ["serial_number", "window"])


def split_of(date: Column, grid: Grid) -> Column:
    return F.when(date < F.lit(grid.train_end).cast("date"), "train").when(date < F.lit(grid.test_start).cast("date"), "calib").otherwise("test")


def split_windows(labelled: DataFrame, grid: Grid, *, strict: bool = False) -> DataFrame:
    """Splits by the first date seen. Windows whose label period starts (strict: or ends) in another split are left out."""
    first = F.col("window_first_date")
    out = labelled.withColumn("split", split_of(first, grid))
    out = out.where(F.col("split") == split_of(F.date_add(first, grid.window_days), grid))
    if strict:
        end = F.date_add(F.lit(grid.epoch).cast("date"), (F.col("window") + 2) * grid.window_days - 1)
        out = out.where(F.col("split") == split_of(end, grid))
    return out


def enough_days(rows: DataFrame, grid: Grid) -> DataFrame:
    """Applied after labels are set: a window of one day can still be what another one is labelled by."""
    return rows.where(F.col("days_observed") >= grid.min_days)


def sample_limits(rows: DataFrame, grid: Grid, *, strata: int = 1, keys: Sequence[str] = ("serial_number", "window")) -> dict[int, str]:
    """The greatest digest that stays in each stratum; strata that keep all their negatives have none.

    One pass over the keys, splits and labels of rows (of an aggregate, Catalyst prunes all else), held while digests are
    counted by prefix and the digests of the one prefix where a stratum's limit falls are ranked. A row for each stratum
    comes to the driver.
    """
    stratum = F.pmod(F.xxhash64(keys[0]), F.lit(strata)).cast("int")
    slim = rows.where("split = 'train'").select(stratum.alias("stratum"), order_digest(grid.seed, *keys).alias("digest"), "label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        prefix = F.substring("digest", 1, 4).alias("prefix")  # 65,536 rows a stratum at most
        counts = slim.groupBy("stratum", prefix).agg(F.count_if(F.col("label") == 0).alias("n"), F.count_if(F.col("label") == 1).alias("positives"))
        of, by = Window.partitionBy("stratum"), Window.partitionBy("stratum").orderBy("prefix")
        marks = counts.select("stratum", "prefix", "n", F.bround(F.sum("positives").over(of) * grid.neg_ratio).cast("long").alias("want"), F.sum("positives").over(of).alias("all"), (F.sum("n").over(by) - F.col("n")).alias("before"))
        edges = marks.where("all > 0 AND (before < want AND before + n >= want OR want = 0)").groupBy("stratum").agg(F.min("prefix").alias("prefix"), F.first(F.col("want") - F.col("before")).alias("left"), F.max("want").alias("want")).collect()
        limits = {r.stratum: "" for r in edges if r.want == 0}
        open_ = [(r.stratum, r.prefix, r.left) for r in edges if r.want]
        if open_:
            edge = F.broadcast(rows.sparkSession.createDataFrame(open_, "stratum int, edge string, left long"))
            near = slim.where("label = 0").select("stratum", "digest", prefix).join(edge, "stratum").where("prefix = edge")
            rank = F.row_number().over(Window.partitionBy("stratum").orderBy("digest"))
            limits |= {r.stratum: r.digest for r in near.withColumn("rank", rank).where("rank = left").select("stratum", "digest").collect()}
    finally:
        slim.unpersist()
    return limits


def sample_negatives(rows: DataFrame, grid: Grid, *, strata: int = 1, keys: Sequence[str] = ("serial_number", "window")) -> DataFrame:
    """Training negatives down to round(positives * neg_ratio) in each stratum, least digests first; no positives: all stay.

    The limits are found beforehand, from few columns, so rows are filtered as they are made and no task sorts all negatives.
    """
    if grid.neg_ratio <= 0:
        return rows
    limits = sample_limits(rows, grid, strata=strata, keys=keys)
    if not limits:
        return rows
    # a digest is below "z"
    cuts = F.split(F.lit(",".join(limits.get(i, "z") for i in range(strata))), ",")
    cut = F.get(cuts, F.pmod(F.xxhash64(keys[0]), F.lit(strata)).cast("int")) if strata > 1 else F.lit(limits[0])
    negative = (F.col("split") == "train") & (F.col("label") == 0)
    return rows.where(~negative | (order_digest(grid.seed, *keys) <= cut))


def strict_grouping(rows: DataFrame) -> DataFrame:
    """Calibration and test rows go if their device has a row in the (sampled) training split."""
    in_train = rows.where("split = 'train'").select("serial_number").distinct()
    return rows.where("split = 'train'").unionByName(rows.where("split <> 'train'").join(in_train, "serial_number", "left_anti"))


def modeling_table(daily: DataFrame, grid: Grid, *, drop_boundary_drives: bool = False, strict: bool = False, strata: int = 1, co_partition: bool | None = None, models: Sequence[str] | None = None) -> DataFrame:
    """Aggregate, label, count exposure, drop short windows, split, sample: a pass over the few columns that say which rows
    are sampled, then one plan for all of it, which keeps nothing in memory."""
    labelled = enough_days(label_windows(aggregate_windows(daily, grid, co_partition=co_partition, models=models)), grid)
    out = sample_negatives(split_windows(labelled, grid, strict=strict), grid, strata=strata)
    return strict_grouping(out) if drop_boundary_drives else out


def split_summary(rows: DataFrame) -> DataFrame:
    positives = F.sum(F.col("label").cast("long"))
    return rows.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        positives.alias("positives"),
        F.floor(F.try_divide(F.count("*"), positives)).cast("long").alias("one_in"),
        F.min("window_first_date").alias("first_date"),
        F.max("window_last_date").alias("last_date"),
        F.count_distinct("serial_number").alias("devices"),
        F.count_distinct("window").alias("windows"),
    )


def write_splits(rows: DataFrame, path: str, *, codec: str = "zstd", one_file: bool = False) -> None:
    """One folder for each split, rows in order of window and device within files; `one_file` makes it one sorted file a split.

    One file is for splits of a size that one task can sort, as in the published tables; by default a window is a task's.
    """
    dealt = rows.repartition("split") if one_file else rows.repartition("split", "window")
    dealt.sortWithinPartitions("split", "window", "serial_number").write.mode("overwrite").partitionBy("split").option("compression", codec).parquet(path)


def split_files(spark: SparkSession, path: str) -> DataFrame:
    """(split, files, bytes) of what write_splits wrote, from the names and sizes of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", "/split=([^/]+)/", 1).alias("split")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
