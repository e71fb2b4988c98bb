"""Device snapshots, windows and scores out of the supplied tables, as DataFrames and as SQL.

`events` stands in for snapshots: a user is a device, a day's last values are its sensors, an error of a value over 150
is a failure. `lineitem` stands in for groups with exposure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinward.operators import windows as W

GRID = W.Grid(epoch="2024-01-01", window_days=3, train_end="2024-01-19", test_start="2024-01-25", neg_ratio=3.0, min_days=2, seed=42)
SENSORS = ["smart_5_raw", "smart_9_raw", "smart_197_raw"]
MODELS = ("ST4000DM000", "TOSHIBA MG07", "WDC WUH721816", "HGST HUH728080", "Hitachi HDS72", "Micron MTFDDAK480")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    by = F.struct("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("double")
    known = F.when(F.col("event_id") % 7 != 0, by)
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % len(MODELS) + 1).cast("int"))
    capacity = F.when(F.col("user_id") % 7 == 0, F.lit(-1)).otherwise((F.col("user_id") % 4 + 1) * 4_000_000_000_000)
    out = e.groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.max_by("value", by).alias("smart_5_raw"),
        F.max_by(k, by).alias("smart_9_raw"),
        F.max_by("value", known).alias("smart_197_raw"),
        F.max(((F.col("event_type") == "error") & (F.col("value") > 150)).cast("byte")).alias("failure"),
    )
    return out.select(F.col("user_id").cast("string").alias("serial_number"), "date", *SENSORS, "failure", model.alias("model"), capacity.cast("long").alias("capacity_bytes"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.aggregate_windows(daily(spark, sf_dir), GRID)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.label_windows(windows(spark, sf_dir))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled windows of enough days, split."""
    return W.split_windows(W.enough_days(labelled(spark, sf_dir), GRID), GRID)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few ties: (id, device, prob, label, flag)."""
    e = read(spark, sf_dir, "events")
    label = (F.col("event_type") == "error").cast("int")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("device"), (F.col("value") / 500.0).alias("prob"), label.alias("label"), (F.col("event_id") % 10 == 3).cast("int").alias("flag"))


def tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven scores: (prob, label)."""
    li = read(spark, sf_dir, "lineitem")
    return li.select((F.col("l_discount") * 10).alias("prob"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


_CASES = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS))
DAILY_SQL = f"""daily AS (
  SELECT CAST(user_id AS VARCHAR) AS serial_number, CAST(ts AS DATE) AS date,
    arg_max(value, (ts, event_id)) AS smart_5_raw,
    arg_max(CAST(json_extract_string(props, '$.k') AS DOUBLE), (ts, event_id)) AS smart_9_raw,
    arg_max(value, (ts, event_id)) FILTER (WHERE event_id % 7 <> 0) AS smart_197_raw,
    CAST(max(CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END) AS TINYINT) AS failure,
    CASE user_id % {len(MODELS)} {_CASES} END AS model,
    CAST(CASE WHEN user_id % 7 = 0 THEN -1 ELSE (user_id % 4 + 1) * 4000000000000 END AS BIGINT) AS capacity_bytes
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""
_ENDS = ", ".join(f"arg_min({s}, date) FILTER (WHERE {s} IS NOT NULL) AS {s}_first, arg_max({s}, date) FILTER (WHERE {s} IS NOT NULL) AS {s}_last" for s in SENSORS)
_DELTAS = ", ".join(f"{s}_last - {s}_first AS {s}_delta" for s in SENSORS)
WINDOWS_SQL = f"""{DAILY_SQL},
grid AS (SELECT *, CAST(floor(date_diff('day', DATE '2024-01-01', date) / 3.0) AS INTEGER) AS "window" FROM daily),
ends AS (SELECT serial_number, "window", {_ENDS}, min(date) AS window_first_date, max(date) AS window_last_date,
    count(date) AS days_observed, arg_max(capacity_bytes, date) AS capacity_bytes, arg_max(model, date) AS model, max(failure) AS failed_in_window
  FROM grid GROUP BY serial_number, "window"),
win AS (SELECT * EXCLUDE (failed_in_window), CAST(date_diff('day', window_first_date, window_last_date) AS SMALLINT) AS days_span, {_DELTAS}, failed_in_window FROM ends)"""
LABELLED_SQL = f"""{WINDOWS_SQL},
ahead AS (SELECT *, lead("window") OVER d AS nxt, lead(failed_in_window) OVER d AS label FROM win WINDOW d AS (PARTITION BY serial_number ORDER BY "window")),
lab AS (SELECT * EXCLUDE (nxt, failed_in_window), CAST(sum(days_observed) OVER (PARTITION BY serial_number ORDER BY "window" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS drive_days_to_date
  FROM ahead WHERE nxt = "window" + 1)"""


def _split(d: str) -> str:
    return f"CASE WHEN {d} < DATE '2024-01-19' THEN 'train' WHEN {d} < DATE '2024-01-25' THEN 'calib' ELSE 'test' END"


ROWS_SQL = f"""{LABELLED_SQL},
rws AS (SELECT *, {_split('window_first_date')} AS split FROM lab
  WHERE days_observed >= 2 AND {_split('window_first_date')} = {_split('(window_first_date + INTERVAL 3 DAY)')})"""
STRICT_SQL = f"""{ROWS_SQL},
strict AS (SELECT * FROM rws WHERE split = {_split("(DATE '2024-01-01' + CAST((\"window\" + 2) * 3 - 1 AS INTEGER))")})"""
SAMPLED_SQL = f"""{ROWS_SQL},
want AS (SELECT CAST(round_even(count(*) * 3.0, 0) AS BIGINT) AS n FROM rws WHERE split = 'train' AND label = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY (split = 'train' AND label = 0) ORDER BY md5(concat_ws('#', 42, serial_number, "window"))) AS rn FROM rws),
smp AS (SELECT * EXCLUDE (rn) FROM ranked WHERE NOT (split = 'train' AND label = 0) OR (SELECT n FROM want) = 0 OR rn <= (SELECT n FROM want))"""
SCORED_SQL = "scored AS (SELECT event_id AS id, user_id AS device, value / 500.0 AS prob, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS flag FROM events)"
TIED_SQL = "tied AS (SELECT l_discount * 10 AS prob, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"
VENDOR_SQL = "CASE WHEN starts_with({0}, 'ST') THEN 'Seagate' WHEN starts_with({0}, 'TOSHIBA') THEN 'Toshiba' WHEN starts_with({0}, 'WDC') OR starts_with({0}, 'WUH') THEN 'WDC' WHEN starts_with({0}, 'HGST') OR starts_with({0}, 'Hitachi') THEN 'HGST' ELSE 'Other' END"
