"""Windows, labels, splits and samples on fixtures worked out by hand."""

import datetime as dt

import pytest

from spinward.functions import columns as C
from spinward.operators import windows as W
from pyspark.sql import functions as F

GRID = W.Grid()
SCHEMA = "serial_number string, date date, smart_5_raw double, failure byte, model string, capacity_bytes long"


def day(n: int, epoch=dt.date(2023, 1, 1)) -> dt.date:
    return epoch + dt.timedelta(days=n)


def frame(spark, rows):
    return spark.createDataFrame([(s, day(n) if isinstance(n, int) else n, x, f, m, c) for s, n, x, f, m, c in rows], SCHEMA)


def snapshots(serial, days, fail=(), value=1.0):
    return [(serial, d, value, int(d in fail), "ST4000", 4_000_000_000_000) for d in days]


def labels(spark, rows, **options):
    out = W.label_windows(W.aggregate_windows(frame(spark, rows), GRID, **options)).collect()
    return sorted((r.serial_number, r.window, r.label, r.days_observed, r.drive_days_to_date) for r in out)


def test_three_windows_without_failure(spark):
    assert labels(spark, snapshots("a", range(90))) == [("a", 0, 0, 30, 30), ("a", 1, 0, 30, 60)]


def test_failure_in_the_next_window(spark):
    assert labels(spark, snapshots("a", range(60), fail={59})) == [("a", 0, 1, 30, 30)]


def test_failure_on_the_first_day_of_a_window(spark):
    assert labels(spark, snapshots("a", range(31), fail={30})) == [("a", 0, 1, 30, 30)]


def test_a_gap_breaks_the_chain(spark):
    rows = snapshots("a", [*range(30), *range(60, 120)])
    assert labels(spark, rows) == [("a", 2, 0, 30, 30)]


def test_short_windows_count_towards_exposure(spark):
    rows = snapshots("a", [0, *range(30, 90)])
    labelled = W.label_windows(W.aggregate_windows(frame(spark, rows), GRID))
    got = [(r.window, r.drive_days_to_date) for r in W.enough_days(labelled, GRID).orderBy("window").collect()]
    assert got == [(1, 31)]


def test_first_and_last_skip_nulls(spark):
    rows = [("a", 0, None, 0, "m1", 5), ("a", 1, 2.0, 0, "m2", None), ("a", 2, 7.0, 0, None, None), ("a", 3, None, 0, None, None), ("b", 0, None, 0, None, None)]
    got = {r.serial_number: r for r in W.aggregate_windows(frame(spark, rows), GRID).collect()}
    a, b = got["a"], got["b"]
    assert (a.smart_5_raw_first, a.smart_5_raw_last, a.smart_5_raw_delta, a.model, a.capacity_bytes, a.days_span) == (2.0, 7.0, 5.0, "m2", 5, 3)
    assert (b.smart_5_raw_first, b.smart_5_raw_delta, b.model) == (None, None, None)


def split(spark, first, last):
    days = (dt.date.fromisoformat(first), dt.date.fromisoformat(last))
    rows = snapshots("a", [days[0] + dt.timedelta(days=i) for i in range((days[1] - days[0]).days + 1)])
    out = W.split_windows(W.label_windows(W.aggregate_windows(frame(spark, rows), GRID)), GRID)
    strict = W.split_windows(W.label_windows(W.aggregate_windows(frame(spark, rows), GRID)), GRID, strict=True)
    return {r.window: r.split for r in out.collect()}, {r.window: r.split for r in strict.collect()}


def test_splits_follow_the_first_date_seen(spark):
    late, _ = split(spark, "2024-11-05", "2024-12-01")
    assert late == {22: "calib"}
    early, _ = split(spark, "2024-10-22", "2024-12-01")
    assert early == {}
    train, strict = split(spark, "2024-09-22", "2024-10-25")
    assert train == {21: "train"} and strict == {}
    ends, _ = split(spark, "2025-11-16", "2026-01-02")
    assert ends == {35: "test"}


def test_windows_before_the_epoch_are_negative(spark):
    got = frame(spark, snapshots("a", [-1, -30, -31, 0])).select(C.grid_index(F.col("date"), "2023-01-01", 30).alias("w")).collect()
    assert sorted(r.w for r in got) == [-2, -1, -1, 0]


def test_repeated_days_count_twice(spark):
    rows = snapshots("a", [0, 0, 1])
    assert W.aggregate_windows(frame(spark, rows), GRID).first().days_observed == 3


def sample_rows(spark, pos, neg):
    rows = [(f"p{i}", 0, "train", 1) for i in range(pos)] + [(f"n{i}", 0, "train", 0) for i in range(neg)] + [(f"c{i}", 22, "calib", 0) for i in range(9)]
    return spark.createDataFrame(rows, "serial_number string, window int, split string, label int")


@pytest.mark.parametrize(("pos", "neg", "ratio", "left"), [(5, 400, 20, 100), (5, 50, 20, 50), (0, 70, 20, 70), (3, 5000, 2.5, 8), (4, 90, 0, 90), (1, 90, 0.1, 0)])
def test_negatives_are_sampled_exactly(spark, pos, neg, ratio, left):
    out = W.sample_negatives(sample_rows(spark, pos, neg), W.Grid(neg_ratio=ratio)).collect()
    assert sum(r.split == "train" and r.label == 0 for r in out) == left
    assert sum(r.label == 1 for r in out) == pos and sum(r.split == "calib" for r in out) == 9


def test_strata_without_positives_keep_all(spark):
    rows = sample_rows(spark, 1, 200)
    out = W.sample_negatives(rows, W.Grid(neg_ratio=3), strata=4).where("label = 0 AND split = 'train'")
    strata = {r.s: r.n for r in rows.where("label = 0 AND split = 'train'").groupBy(F.pmod(F.xxhash64("serial_number"), F.lit(4)).alias("s")).agg(F.count("*").alias("n")).collect()}
    hit = rows.where("label = 1").select(F.pmod(F.xxhash64("serial_number"), F.lit(4)).alias("s")).first().s
    assert out.count() == sum(n for s, n in strata.items() if s != hit) + min(3, strata[hit])


def test_the_seed_matters(spark):
    rows = sample_rows(spark, 5, 400)
    a, b = ({r.serial_number for r in W.sample_negatives(rows, W.Grid(seed=s)).where("label = 0").collect()} for s in (1, 2))
    assert a != b


def test_partitioning_changes_nothing(spark):
    rows = [r for s in "abcdef" for r in snapshots(s, range(ord(s) % 7, 200, 1 + ord(s) % 3), fail={190}, value=float(ord(s)))]
    want = None
    for n, co, models in ((1, True, None), (7, False, None), (64, True, ["ST4000", "other"])):
        got = sorted(map(tuple, W.modeling_table(frame(spark, rows).repartition(n), GRID, co_partition=co, models=models).collect()))
        want = want or got
        assert got == want and got


def test_labels_are_the_only_look_ahead(spark):
    rows = snapshots("a", range(90))
    changed = [(s, d, 99.0 if d >= 60 else x, int(d == 70), m, c) for s, d, x, _, m, c in rows]
    a, b = ({r.window: r.asDict() for r in W.label_windows(W.aggregate_windows(frame(spark, x), GRID)).collect()} for x in (rows, changed))
    assert a[0] == b[0]
    assert {k for k in a[1] if a[1][k] != b[1][k]} == {"label"}


def test_the_fleet_generator_and_model_numbers(spark):
    from spinward.sources.generate import fleet

    daily = fleet(spark, 40, 100, failing=0.3).cache()
    assert daily.where("failure = 1").count() > 0 and len(W.sensors_of(daily)) == 28
    names = W.model_names(daily)
    assert len(names) == 5 and W.model_names(daily, 2) is None
    by_name, by_number = (W.aggregate_windows(daily, GRID, models=m) for m in (None, names))
    assert len(by_name.columns) == 3 * 28 + 9 and by_name.columns == by_number.columns
    assert by_name.exceptAll(by_number).count() == 0 and by_name.count() == by_number.count()
    assert "SortAggregate" not in by_number._jdf.queryExecution().executedPlan().toString()


def test_strict_grouping(spark):
    rows = spark.createDataFrame([("a", 0, "train"), ("a", 23, "calib"), ("b", 23, "calib"), ("b", 30, "test")], "serial_number string, window int, split string")
    got = sorted(map(tuple, W.strict_grouping(rows).collect()))
    assert got == [("a", 0, "train"), ("b", 23, "calib"), ("b", 30, "test")]


def test_grids_are_validated():
    with pytest.raises(ValueError):
        W.Grid(train_end="2025-06-01")


def test_written_splits_read_back(spark, tmp_path):
    rows = W.modeling_table(frame(spark, snapshots("a", range(90))), GRID)
    W.write_splits(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("split = 'train'").count() == rows.count()


def test_one_exchange_by_device(spark):
    plan = W.label_windows(W.aggregate_windows(frame(spark, snapshots("a", range(9))), GRID))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan
