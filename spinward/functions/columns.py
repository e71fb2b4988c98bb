"""Column expressions: device attributes, transforms, bins and intervals. All of them stay within generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings, in any case, that mark a model as a solid-state drive. Fixed values.
SSD_MARKERS = ("ssd", "mtfddav", "mtfddak", "dellboss", "wds250g2b0a", "za250nm", "sa510")
#: Prefixes of model names, in the order in which they are tried. Fixed values.
VENDOR_PREFIXES = (("Seagate", ("ST",)), ("Toshiba", ("TOSHIBA",)), ("WDC", ("WDC", "WUH")), ("HGST", ("HGST", "Hitachi")))
VENDORS = ("Seagate", "Toshiba", "WDC", "HGST", "Other")
#: SMART attributes that are kept. Fixed values.
SMART_IDS = (1, 3, 4, 5, 7, 9, 10, 12, 192, 193, 194, 197, 198, 199)
ID_COLUMNS = ("capacity_bytes", "date", "failure", "model", "serial_number")
NON_FEATURE_COLUMNS = ("serial_number", "window", "window_first_date", "window_last_date", "label")
AGE_EDGES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 14)


def has_marker(model: Column, markers: Sequence[str] = SSD_MARKERS) -> Column:
    """True if the model holds one of the markers in any case; a missing model holds none."""
    return F.coalesce(model.rlike("(?i)" + "|".join(markers)), F.lit(False))


def vendor(model: Column, prefixes: Sequence[tuple[str, Sequence[str]]] = VENDOR_PREFIXES) -> Column:
    out = F.lit("Other")
    for name, starts in reversed(prefixes):
        fits = F.lit(False)
        for s in starts:
            fits = fits | model.startswith(s)
        out = F.when(fits, name).otherwise(out)
    return out


def missing_as_null(value: Column) -> Column:
    """NaN is a missing value, never a number."""
    return F.when(~F.isnan(value), value)


def known_capacity(capacity: Column) -> Column:
    """Unknown capacities (-1, 0) are null."""
    return F.when(capacity > 0, capacity)


def capacity_tb(capacity: Column) -> Column:
    return F.bround(known_capacity(capacity) / 1e12, 0)


def age_years(power_on_hours: Column) -> Column:
    return power_on_hours / (24 * 365.25)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def log1p_clip(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def grid_index(date: Column, epoch: str, days: int) -> Column:
    """The number of the calendar window, from `epoch` on; negative before it."""
    return F.floor(F.datediff(date, F.lit(epoch).cast("date")) / days).cast("int")


def left_closed_bin(x: Column, edges: Sequence[float] = AGE_EDGES) -> Column:
    """`[lo, hi)` as text; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:], strict=False):
        out = F.when((x >= lo) & (x < hi), f"[{lo}, {hi})").otherwise(out)
    return out


def value_bucket(x: Column) -> Column:
    """Counts by powers, closed on the right."""
    out = F.when(x > 512.5, ">512")
    for lo, hi, name in ((64.5, 512.5, "65-512"), (8.5, 64.5, "9-64"), (1.5, 8.5, "2-8"), (0.5, 1.5, "1"), (-0.5, 0.5, "0")):
        out = out.when((x > lo) & (x <= hi), name)
    return out


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """(share, low, high) of k in n; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return p, centre - half, centre + half


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def quarter_of(path: Column) -> Column:
    """`data_Q1_2023.zip` is Q1_2023; other names keep their stem."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.regexp_replace(stem, "^data_", "")


def quarter_order(quarter: Column) -> Column:
    """Orders names like Q1_2023 by year, then by quarter; other names come first, by themselves."""
    year, n = F.regexp_extract(quarter, r"(\d{4})", 1), F.regexp_extract(quarter, r"(?i)Q(\d)", 1)
    return F.struct(year.alias("year"), n.alias("n"), quarter.alias("name"))


def order_digest(seed: int, *keys: str) -> Column:
    """A number that orders rows at random, the same in every run and for every partitioning."""
    return F.md5(F.concat_ws("#", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
