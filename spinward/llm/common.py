"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinward.session import ship

#: Lower-cases A-Z only, byte by byte, so UTF-8 sequences stay as they are.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound what one Arrow batch holds, by rows and, where Spark knows the setting, by bytes; give workers the code."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def keep(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir.

    Where that is unset (local sessions, as in tests) a folder of this machine is set as checkpoint folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spinward-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps don't recompute it, lost executors don't lose it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(values: list, sizes: list[int], limit: int) -> Iterator[slice]:
    """Slices of consecutive values with about limit in size each, one value at least."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield slice(lo, i)
            lo, total = i, 0
        total += n
    if lo < len(values):
        yield slice(lo, len(values))
