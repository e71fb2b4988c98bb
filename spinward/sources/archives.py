"""Reading daily CSV members of zip archives, and CSV files, into narrowed and typed tables; writing and checking them.

A zip archive can't be split, so a task reads a whole one; its members are streamed, one row batch after the other.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spinward.functions.columns import ID_COLUMNS, has_marker, missing_as_null, quarter_of
from spinward.session import ship


def daily_members(names: Sequence[str]) -> list[str]:
    """CSV members in order of name, without the copies that archivers of other systems leave."""
    out = sorted(n for n in names if n.endswith(".csv") and not n.startswith("__MACOSX") and not n.rpartition("/")[2].startswith("._"))
    if not out:
        raise ValueError("the archive holds no daily files")
    return out


def column_type(name: str) -> T.DataType:
    kinds = {"date": T.DateType(), "serial_number": T.StringType(), "model": T.StringType(), "capacity_bytes": T.LongType(), "failure": T.ByteType()}
    return kinds.get(name) or (T.FloatType() if name.endswith("_normalized") else T.DoubleType())


def schema_of(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, column_type(c)) for c in columns])


def read_locked_columns(lines: Sequence[str]) -> list[str]:
    """Column names, one a line; the five identifying ones must be among them."""
    out = [x.strip() for x in lines if x.strip()]
    if missing := [c for c in ID_COLUMNS if c not in out]:
        raise ValueError(f"columns that must be there are missing: {missing}")
    return out


def read_zips(spark: SparkSession, paths: Sequence[str] | str, *, rows: int = 5000) -> DataFrame:
    """(path, member, header, cells) of all rows of all members of the archives, as text; any path that Spark can list."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "member", "header", "cells"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    for member in daily_members(archive.namelist()):
                        with archive.open(member) as raw:
                            lines = csv.reader(io.TextIOWrapper(raw, "utf-8", newline=""))
                            header = next(lines, None)
                            some: list[list[str | None]] = []
                            for line in lines:
                                some.append([x or None for x in line])
                                if len(some) >= rows:
                                    yield _batch(path, member, header, some, names)
                                    some = []
                            if header:
                                yield _batch(path, member, header, some, names)

    return files.mapInArrow(run, "path string, member string, header array<string>, cells array<string>")


def _batch(path: str, member: str, header: list[str], cells: list, names: list[str]) -> pa.RecordBatch:
    n = len(cells)
    text = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array([header] * n, text), pa.array(cells, text)], names=names)


def typed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """quarter and the typed columns, found by header names; columns that a header lacks, empty and unreadable cells are null."""
    def cell(c: str):
        at = F.array_position("header", c)
        return F.when(at > 0, F.get("cells", (at - 1).cast("int"))).try_cast(column_type(c)).alias(c)

    return clean(rows.select(quarter_of(F.col("path")).alias("quarter"), *[cell(c) for c in columns]))


def clean(rows: DataFrame) -> DataFrame:
    """NaN is null in every floating column."""
    return rows.select(*[missing_as_null(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes])


def read_csv(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str]) -> DataFrame:
    """Typed daily CSV files: each file's own header decides where a column is."""
    ship(spark)
    files = spark.read.option("recursiveFileLookup", True).format("binaryFile").option("pathGlobFilter", "*.csv").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "member", "header", "cells"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = csv.reader(io.TextIOWrapper(io.BufferedReader(pa.BufferReader(content.as_buffer())), "utf-8", newline=""))
                header, some = next(lines, None), []
                for line in lines:
                    some.append([x or None for x in line])
                    if len(some) >= 5000:
                        yield _batch(path, path, header, some, names)
                        some = []
                if header:
                    yield _batch(path, path, header, some, names)

    return typed(files.mapInArrow(run, "path string, member string, header array<string>, cells array<string>"), columns)


def headers_of(rows: DataFrame) -> DataFrame:
    """(quarter, column) of the headers, whether or not a column is ever filled."""
    return rows.select(quarter_of(F.col("path")).alias("quarter"), "header").distinct().select("quarter", F.explode("header").alias("column")).distinct()


def all_text(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """quarter and all columns as text, for profiles of what is filled."""
    return rows.select(quarter_of(F.col("path")).alias("quarter"), *[F.when(F.array_position("header", c) > 0, F.get("cells", (F.array_position("header", c) - 1).cast("int"))).alias(c) for c in columns])


def ingest(rows: DataFrame, columns: Sequence[str], path: str, *, codec: str = "zstd", overwrite: bool = False) -> DataFrame:
    """Drops solid-state drives, writes a folder for each quarter that is not there yet and returns what was written.

    Written files are published by the committer in one step; with `overwrite` only the quarters in `rows` are replaced.
    """
    spark = rows.sparkSession
    kept = typed(rows, columns).where(~has_marker(F.col("model")))
    if not overwrite:
        try:
            there = [r.quarter for r in spark.read.parquet(path).select("quarter").distinct().collect()]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            there = []
        kept = kept.where(~F.col("quarter").isin(there)) if there else kept
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    kept.repartition("quarter", "date").sortWithinPartitions("date").write.mode("overwrite").partitionBy("quarter").option("compression", codec).parquet(path)
    return spark.read.parquet(path)


def verify_counts(source: DataFrame, written: DataFrame) -> DataFrame:
    """(quarter, rows_in, rows_kept, on_disk) where the rows kept differ from those on disk: empty if all is well."""
    a = source.groupBy("quarter").agg(F.count("*").alias("rows_in"), F.count_if(~has_marker(F.col("model"))).alias("rows_kept"))
    b = written.groupBy(F.col("quarter").cast("string").alias("quarter")).agg(F.count("*").alias("on_disk"))
    return a.join(b, "quarter", "full").where(~F.col("rows_kept").eqNullSafe(F.coalesce("on_disk", F.lit(0))))


def write_csv(df: DataFrame, path: str, *, one_file: bool = True) -> None:
    """A report or predictions as CSV with a header; one file only for tables of report size."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_bucketed(daily: DataFrame, name: str, buckets: int = 64) -> None:
    """A table dealt into buckets by device, so that later runs need no exchange."""
    daily.write.mode("overwrite").bucketBy(buckets, "serial_number").sortBy("serial_number", "date").saveAsTable(name)


def source_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes) of files, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
