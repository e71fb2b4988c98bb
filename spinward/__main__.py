"""Command line: python -m spinward coverage | dataset | modeling ..."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from spinward.functions.columns import ID_COLUMNS
from spinward.operators import profile
from spinward.operators.windows import Grid, model_names, modeling_table, split_summary, write_splits
from spinward.session import session
from spinward.sources import archives


def _text(spark, path: str) -> list[str]:
    return [r.value for r in spark.read.text(path).collect()]


def coverage(args, spark) -> None:
    rows = archives.read_zips(spark, args.zips)
    headers = archives.headers_of(rows).cache()
    parts = [r.quarter for r in headers.select("quarter").distinct().collect()]
    columns = [r.column for r in headers.select("column").distinct().orderBy("column").collect()]
    text = archives.all_text(rows, columns)
    counts = profile.non_null_counts(text, columns, ["quarter"]).cache()
    cover = profile.coverage(counts)
    archives.write_csv(cover, args.out)
    if args.per_quarter_out:
        archives.write_csv(profile.part_coverage(counts), args.per_quarter_out)
    if args.models_out:
        archives.write_csv(profile.model_counts(text), args.models_out)
    if args.columns_out:
        locked = profile.locked_columns(cover, headers, parts, required=ID_COLUMNS, min_coverage=args.min_coverage)
        locked.select(F.col("column").alias("value")).coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(args.columns_out)
    profile.coverage_counters(cover).show()
    profile.presence(headers, parts).show(100, truncate=False)


def dataset(args, spark) -> None:
    columns = archives.read_locked_columns(_text(spark, args.columns))
    rows = archives.read_zips(spark, args.zips)
    written = archives.ingest(rows, columns, args.out_dir, codec=args.compression, overwrite=args.overwrite)
    source = archives.typed(rows, columns)
    if not (bad := archives.verify_counts(source, written)).isEmpty():
        bad.show(100)
        raise SystemExit("rows on disk differ from the rows kept")
    from spinward.functions.columns import has_marker

    profile.quarter_report(source, "quarter", dropped=has_marker(F.col("model")), failed=F.col("failure") == 1).show(100)


def modeling(args, spark) -> None:
    grid = Grid(args.epoch, args.window_days, args.train_end, args.test_start, args.neg_ratio, args.min_days, args.seed)
    daily = spark.read.parquet(args.in_dir).drop("quarter")
    rows = modeling_table(daily, grid, drop_boundary_drives=args.drop_boundary_drives, strict=args.strict_buffer, strata=args.strata, models=model_names(daily))
    write_splits(rows, args.out_dir)
    split_summary(spark.read.schema(rows.schema).parquet(args.out_dir)).show()


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="spinward")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("coverage")
    c.add_argument("zips", nargs="+")
    c.add_argument("--out", required=True)
    c.add_argument("--per-quarter-out")
    c.add_argument("--columns-out")
    c.add_argument("--models-out")
    c.add_argument("--min-coverage", type=float, default=90.0)
    d = sub.add_parser("dataset")
    d.add_argument("zips", nargs="+")
    d.add_argument("--columns", required=True)
    d.add_argument("--out-dir", required=True)
    d.add_argument("--compression", default="zstd", choices=["zstd", "snappy", "gzip", "none"])
    d.add_argument("--overwrite", action="store_true")
    m = sub.add_parser("modeling")
    m.add_argument("--in-dir", required=True)
    m.add_argument("--out-dir", required=True)
    m.add_argument("--window-days", type=int, default=30)
    m.add_argument("--epoch", default="2023-01-01")
    m.add_argument("--train-end", default="2024-11-01")
    m.add_argument("--test-start", default="2025-01-01")
    m.add_argument("--neg-ratio", type=float, default=20.0)
    m.add_argument("--min-days", type=int, default=2)
    m.add_argument("--seed", type=int, default=42)
    m.add_argument("--strata", type=int, default=1)
    m.add_argument("--drop-boundary-drives", action="store_true")
    m.add_argument("--strict-buffer", action="store_true")
    args = top.parse_args(argv)
    {"coverage": coverage, "dataset": dataset, "modeling": modeling}[args.command](args, session())


if __name__ == "__main__":
    main()
