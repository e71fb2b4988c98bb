"""The calendar windows over a stream of snapshots: a window is final once the watermark has passed its end."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinward.operators.windows import Grid, first_of, last_of


def stream_windows(snapshots: DataFrame, sensors: list[str], grid: Grid, *, time_col: str = "ts", late: str = "2 days") -> DataFrame:
    """As aggregate_windows, from a stream or a table with a timestamp: first and last known values, span, days, failure.

    Windows are aligned to the grid's epoch. Rows later than `late` are dropped by the watermark.
    """
    days = f"{grid.window_days} days"
    shift = (date.fromisoformat(grid.epoch) - date(1970, 1, 1)).days % grid.window_days
    rows = snapshots.withWatermark(time_col, late)
    # days seen, a bit each; a window starts so many days after a multiple of its length
    day = F.pmod(F.datediff(F.to_date(time_col), F.lit(grid.epoch).cast("date")), F.lit(grid.window_days))
    marks = range(0, grid.window_days, 63)
    ends = [f(s, time_col).alias(f"{s}_{name}") for s in sensors for name, f in (("first", first_of), ("last", last_of))]
    out = rows.groupBy("serial_number", F.window(time_col, days, days, f"{shift} days").alias("span")).agg(
        *ends,
        F.min(time_col).alias("first_seen"),
        F.max(time_col).alias("last_seen"),
        *[F.bit_or(F.when((day >= lo) & (day < lo + 63), F.call_function("shiftleft", F.lit(1).cast("long"), (day - lo).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"_days{lo}") for lo in marks],
        F.max("failure").alias("failed_in_window"),
    )
    number = F.floor(F.datediff(F.to_date("span.start"), F.lit(grid.epoch).cast("date")) / grid.window_days).cast("int")
    days_seen = sum((F.bit_count(f"_days{lo}") for lo in marks), F.lit(0)).cast("long").alias("days_observed")
    rest = [c for c in out.columns if c not in ("serial_number", "span", "failed_in_window") and not c.startswith("_days")]
    return out.select("serial_number", number.alias("window"), *rest, days_seen, "failed_in_window")
