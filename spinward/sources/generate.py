"""Made-up snapshots of a fleet, the same for the same arguments, for measuring throughput and for trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinward.functions.columns import SMART_IDS


def _unit(*keys: Column | int) -> Column:
    """A number in [0, 1) from keys."""
    return F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys]), F.lit(1 << 30)) / float(1 << 30)


def fleet(spark: SparkSession, devices: int, days: int, *, epoch: str = "2023-01-01", failing: float = 0.05, partitions: int = 16) -> DataFrame:
    """capacity_bytes, date, failure, model, serial_number and both forms of 14 sensors, a row for each device and day.

    A share of the devices fails on some day and has no row after it; their counters grow in the weeks before.
    """
    d = spark.range(devices, numPartitions=partitions).withColumnRenamed("id", "device")
    dies = F.when(_unit(F.col("device"), 1) < failing, F.floor(_unit(F.col("device"), 2) * days)).otherwise(days + 1).cast("int")
    d = d.select("device", dies.alias("dies"), F.explode(F.sequence(F.lit(0), F.least(dies, F.lit(days - 1)))).alias("day"))
    models = F.array(*[F.lit(m) for m in ("ST4000DM000", "TOSHIBA MG07ACA14TA", "WUH721816ALE6L4", "HGST HUH728080ALE600", "ST12000NM0007")])
    near = F.greatest(F.lit(0.0), 30.0 - (F.col("dies") - F.col("day")))
    sensors = []
    for i in SMART_IDS:
        raw = F.floor(_unit(F.col("device"), F.col("day"), i) * 100) + (F.floor(near * near) if i in (5, 197, 198) else 0) + F.col("day") * (24 if i == 9 else 0)
        raw = F.when(_unit(F.col("device"), F.col("day"), i, 7) >= 0.02, raw.cast("double"))
        sensors += [F.greatest(F.lit(0.0), 100 - raw / 50).cast("float").alias(f"smart_{i}_normalized"), raw.alias(f"smart_{i}_raw")]
    return d.select(
        F.when(F.col("device") % 50 == 0, -1).otherwise((F.col("device") % 4 + 1) * 4_000_000_000_000).cast("long").alias("capacity_bytes"),
        F.date_add(F.lit(epoch).cast("date"), F.col("day")).alias("date"),
        (F.col("day") == F.col("dies")).cast("byte").alias("failure"),
        F.element_at(models, (F.col("device") % 5 + 1).cast("int")).alias("model"),
        F.concat(F.lit("S"), F.lpad(F.col("device").cast("string"), 9, "0")).alias("serial_number"),
        *sensors,
    )
