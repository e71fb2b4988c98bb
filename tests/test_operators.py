"""Expressions, profiles, statistics, metrics, features, sources and streams."""

import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spinward.functions import columns as C
from spinward.operators import distributions as Q
from spinward.operators import features as X
from spinward.operators import metrics as M
from spinward.operators import profile as P
from spinward.operators import ranks as K
from spinward.operators import rates as R
from spinward.operators import stats as S
from spinward.operators import windows as W
from spinward.sources import archives as Z


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("model", "dropped", "vendor"), [("Micron 5300 MTFDDAK480TDS", True, "Other"), ("DELLBOSS VD", True, "Other"), ("SSDSCKKB480G8R", True, "Other"), ("WDC WUH721816ALE6L4", False, "WDC"), (None, False, "Other"), ("st4000", False, "Other"), ("ST4000", False, "Seagate"), ("Hitachi HDS", False, "HGST"), ("HUH728", False, "Other"), ("TOSHIBA MG", False, "Toshiba")])
def test_models(spark, model, dropped, vendor):
    assert one(spark, model, "string", C.has_marker) is dropped
    assert one(spark, model, "string", C.vendor) == vendor


@pytest.mark.parametrize(("capacity", "tb"), [(-1, None), (0, None), (500_000_000_000, 0.0), (2_500_000_000_000, 2.0), (3_500_000_000_000, 4.0), (None, None)])
def test_capacities_round_half_to_even(spark, capacity, tb):
    assert one(spark, capacity, "long", C.capacity_tb) == tb


def test_bins(spark):
    assert [one(spark, x, "double", C.left_closed_bin) for x in (0.0, 0.999, 1.0, 9.0, 13.9, 14.0, -0.1, None)] == ["[0, 1)", "[0, 1)", "[1, 2)", "[8, 10)", "[10, 14)", None, None, None]
    assert [one(spark, x, "double", C.value_bucket) for x in (0.0, 0.5, 1.0, 1.5, 8.5, 9.0, 64.5, 512.5, 513.0, -1.0, None)] == ["0", "0", "1", "1", "2-8", "9-64", "9-64", "65-512", ">512", None, None]


def test_missing_values_never_exceed_anything(spark):
    rows = spark.createDataFrame([(float("nan"), 1), (None, 0), (2.0, 1), (0.0, 0)], "x double, label int")
    got = M.rule_baseline(rows.withColumn("x", C.missing_as_null(F.col("x"))), "x", F.col("label")).first()
    assert (got.flagged, got.tp, got.recall) == (1, 1, 0.5)


def test_transforms(spark):
    assert one(spark, -3.0, "double", C.signed_log) == pytest.approx(-math.log(4))
    assert one(spark, -3.0, "double", C.log1p_clip) == 0.0
    assert one(spark, None, "double", C.log1p_clip) is None


def test_wilson(spark):
    rows = spark.createDataFrame([(0, 10), (3, 10), (0, 0)], "k long, n long")
    got = rows.select(*[c.alias(n) for c, n in zip(C.wilson(F.col("k"), F.col("n")), "plh", strict=True)]).collect()
    assert got[0].l == pytest.approx(0, abs=1e-12) and got[0].h == pytest.approx(0.27753, abs=1e-4)
    assert (got[1].l, got[1].h) == pytest.approx((0.10779, 0.60322), abs=1e-4)
    assert got[2].p is None


def test_quarters(spark):
    assert [one(spark, p, "string", C.quarter_of) for p in ("file:/a/data_Q1_2023.zip", "b/other.csv")] == ["Q1_2023", "other"]


def test_average_precision_and_auc_with_ties(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.8, 0), (0.1, 0)], "prob double, label int")
    assert M.average_precision(rows, "prob", F.col("label")).first()[0] == pytest.approx(0.8333333, abs=1e-6)
    assert M.roc_auc(rows, "prob", F.col("label")).first()[0] == pytest.approx(0.875)
    only = rows.where("label = 0")
    assert M.average_precision(only, "prob", F.col("label")).first()[0] is None
    assert S.oriented_aucs(only, ["prob"], F.col("label")).first().auc == 0.5


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_over_several_ranges(spark, descending):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("double").alias("k"), (F.col("id") % 13).alias("v"))
    got = {r.k: r.v_to for r in K.running_totals(rows, "k", ["v"], descending=descending).collect()}
    total, want = 0, {}
    for k, v in sorted(((r.k, r.v) for r in rows.collect()), reverse=descending):
        total += v
        want[k] = total
    assert got == want


def test_running_totals_by_group_and_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(x)) for g, n in (("a", 501), ("b", 40), ("c", 1)) for x in rng.integers(0, 60, n)] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    counts = df.where("x IS NOT NULL").groupBy("g", "x").count()
    for r in K.running_totals(counts, "x", ["count"], by=["g"]).collect():
        assert r.count_to == sum(g == r.g and x <= r.x for g, x in rows if x is not None)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in K.quantiles(df, shares, by=["g"]).collect()}
    assert set(got) == set("abc")
    for g, q in got.items():
        assert q == pytest.approx(np.quantile([x for h, x in rows if h == g and x is not None], shares))


def test_stages_do_not_grow_with_the_number_of_features(spark):
    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    df = spark.range(200).selectExpr("id % 2 AS y", *[f"CAST((id * {k}) % 17 AS DOUBLE) AS f{k}" for k in range(2, 12)])
    of = lambda n: [f"f{k}" for k in range(2, 2 + n)]
    for make in (lambda n: S.oriented_aucs(df, of(n), F.col("y")), lambda n: S.spearman(df, of(n)), lambda n: S.transform_table(df, of(n), F.col("y")), lambda n: S.moments(df, of(n))):
        assert exchanges(make(3)) == exchanges(make(10))
    assert sorted(r.auc for r in S.oriented_aucs(df, of(10), F.col("y")).collect())[0] >= 0.5


def test_average_ranks(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (None,)], "x double")
    assert {r.x: r.rank for r in K.average_ranks(rows.groupBy("x").count().withColumnRenamed("count", "n"), "x").collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_spearman_leaves_out_unknown_pairs(spark):
    rows = spark.createDataFrame([(1.0, 3.0), (2.0, None), (3.0, 9.0), (4.0, 12.0)], "a double, b double")
    got = S.spearman(rows, ["a", "b"]).first()
    assert got.n == 3 and got.rho == pytest.approx(1.0)


def test_chi_square_and_its_tail(spark):
    table = spark.createDataFrame([("x", 10, 20), ("y", 30, 5), ("z", 0, 0)], "k string, a long, b long")
    got = S.chi_square(table, ["a", "b"])
    r = got.first()
    assert r.dof == 1 and r.chi2 == pytest.approx(16.57848, abs=1e-4)
    assert S.chi_square_p(got) == pytest.approx(4.67e-5, rel=0.02)


def test_distributions(spark):
    low, high = Q.poisson_limits(spark, 0)
    assert low == 0 and high == pytest.approx(3.68888, abs=1e-4)
    low, high = Q.poisson_limits(spark, 10)
    assert (low, high) == pytest.approx((4.79539, 18.39036), abs=1e-4)
    w, p = Q.wilcoxon_signed_rank([1, 2, 3, 4, 5], [0, 0, 0, 0, 0.0])
    assert (w, p) == (0.0, 0.0625)
    assert Q.wilcoxon_signed_rank([1.0], [1.0]) == (0.0, 1.0)


def test_mutual_information_tells_signal_from_noise(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(i % 2) + rng.normal() * 0.2, rng.normal(), i % 2) for i in range(600)]
    got = {r.feature: r.mi for r in S.mutual_information(spark.createDataFrame(rows, "id long, s double, z double, label int"), ["s", "z"], "label", keys=["id"]).collect()}
    assert got["s"] > 0.5 and got["z"] < 0.1


def test_calibration_and_reliability(spark):
    rows = spark.createDataFrame([(i / 100, int(i % 3 == 0)) for i in range(100)], "prob double, label int")
    got = M.reliability(rows, "prob", F.col("label")).collect()
    assert len(got) == 10 and sum(r.n for r in got) == 100
    flat = M.reliability(rows.withColumn("prob", F.lit(0.5)), "prob", F.col("label")).collect()
    assert len(flat) == 1 and flat[0].n == 100


def test_budgets_break_ties_by_key(spark):
    rows = spark.createDataFrame([(i, 0.5, int(i < 2)) for i in range(1000)], "id long, prob double, label int")
    got = M.budget_table(rows, "prob", F.col("label"), ["id"], [1, 2, 0.5]).collect()
    assert [(r.budget, r.precision, r.recall) for r in got] == [(1, 1.0, 0.5), (2, 1.0, 1.0), (0, 0.0, 0.0)]


def test_time_folds():
    folds = X.time_folds(range(22))
    assert [(max(t), v[0], v[-1]) for t, v in folds] == [(3, 5, 9), (8, 10, 13), (12, 14, 17), (16, 18, 21)]


def test_preparation_is_fitted_on_training_rows_only(spark, tmp_path):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, None), (None, 5.0)], "a double, b double")
    prep = X.Preparation(["a", "b"], log=False).fit(train)
    assert prep.medians == {"a": 2.0, "b": 5.0} and prep.with_nulls == ["a", "b"] and prep.deviation["b"] == 1.0
    prep.save(spark, str(tmp_path / "prep"))
    prep = X.Preparation.load(spark, str(tmp_path / "prep"))
    other = prep.apply(spark.createDataFrame([(None, 6.0)], "a double, b double")).first()
    assert other.a == pytest.approx(0.0) and other.b == pytest.approx(1.0) and other.a_missing > 0


def test_presence_and_locked_columns(spark):
    headers = spark.createDataFrame([("Q1", "model"), ("Q2", "model"), ("Q1", "smart_1_raw"), ("Q2", "smart_1_raw"), ("Q1", "smart_9_raw")], "quarter string, column string")
    assert [tuple(r) for r in P.presence(headers, ["Q1", "Q2"]).collect()] == [("smart_9_raw", 1, "Q2")]
    rows = spark.createDataFrame([("m", 1.0, 1.0), (None, 2.0, 2.0)], "model string, smart_1_raw double, smart_9_raw double")
    cover = P.coverage(P.non_null_counts(rows))
    assert sorted(r.column for r in P.locked_columns(cover, headers, ["Q1", "Q2"], required=["model"]).collect()) == ["model", "smart_1_raw"]


def test_tables_without_rows(spark):
    none = spark.createDataFrame([], "prob double, label int, g string")
    y = F.col("label")
    assert M.average_precision(none, "prob", y).first()[0] is None
    assert M.threshold_sweep(none, "prob", y, [0.5]).first().f1 == 0.0
    assert M.reliability(none, "prob", y).count() == 0
    assert S.kruskal_wallis(none, "prob", "g").first().h is None
    assert R.wilson_table(none, ["g"], y).count() == 0
    assert P.duplicates(none, ["g"]).first().duplicates == 0


CSV = {
    "data_Q1_2023.zip": {"2023-01-01.csv": "date,serial_number,model,capacity_bytes,failure,smart_5_raw,smart_5_normalized,extra\n2023-01-01,a,ST4000,4000,0,1,100,z\n2023-01-01,b,Samsung SSD,4000,0,,,z\n", "__MACOSX/2023-01-01.csv": "x\n1\n", "d/._2023-01-01.csv": "x\n1\n"},
    "data_Q2_2023.zip": {"2023-04-01.csv": "serial_number,date,failure,model,capacity_bytes,smart_5_raw,new\na,2023-04-01,1,ST4000,-1,nan,3\n", "2023-04-02.csv": "serial_number,date,failure,model,capacity_bytes,smart_5_raw,new\nc,2023-04-02,0,,oops,7,3\n"},
}
LOCKED = ["capacity_bytes", "date", "failure", "model", "serial_number", "smart_5_normalized", "smart_5_raw"]


@pytest.fixture
def zips(tmp_path):
    for name, members in CSV.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m, text in members.items():
                z.writestr(m, text)
    return str(tmp_path)


def test_archives_are_read_typed_and_written(spark, zips, tmp_path):
    rows = Z.read_zips(spark, zips)
    got = {(r.quarter, r.serial_number): r for r in Z.typed(rows, LOCKED).collect()}
    assert set(got) == {("Q1_2023", "a"), ("Q1_2023", "b"), ("Q2_2023", "a"), ("Q2_2023", "c")}
    assert got["Q1_2023", "a"].smart_5_raw == 1.0 and got["Q2_2023", "a"].smart_5_raw is None
    assert got["Q2_2023", "a"].smart_5_normalized is None and got["Q2_2023", "c"].capacity_bytes is None and got["Q2_2023", "c"].model is None
    headers = Z.headers_of(rows)
    assert {r.column for r in P.presence(headers, ["Q1_2023", "Q2_2023"]).collect()} == {"extra", "new", "smart_5_normalized"}
    out = str(tmp_path / "out")
    written = Z.ingest(rows, LOCKED, out)
    assert sorted(r.serial_number for r in written.collect()) == ["a", "a", "c"]
    assert Z.verify_counts(Z.typed(rows, LOCKED), written).count() == 0
    assert Z.ingest(rows, LOCKED, out).count() == 3  # what is there stays
    assert Z.ingest(rows, LOCKED, out, overwrite=True).count() == 3
    assert Z.source_sizes(spark, zips, "*.zip").count() == 2


def test_csv_files_by_their_own_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "2023-04-01.csv").write_text(CSV["data_Q2_2023.zip"]["2023-04-01.csv"])
    (tmp_path / "in" / "2023-01-01.csv").write_text(CSV["data_Q1_2023.zip"]["2023-01-01.csv"])
    got = {(r.serial_number, str(r.date)): r.model for r in Z.read_csv(spark, str(tmp_path / "in"), LOCKED).collect()}
    assert got == {("a", "2023-04-01"): "ST4000", ("a", "2023-01-01"): "ST4000", ("b", "2023-01-01"): "Samsung SSD"}


def test_locked_columns_need_the_identifying_ones():
    assert Z.read_locked_columns(LOCKED) == LOCKED
    with pytest.raises(ValueError):
        Z.read_locked_columns(["model"])
    with pytest.raises(ValueError):
        Z.daily_members(["__MACOSX/a.csv", "x/._b.csv"])


def test_csv_sink(spark, tmp_path):
    Z.write_csv(spark.createDataFrame([("a", 0.5)], "serial_number string, prob double"), str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).first().prob == "0.5"


def test_command_line(spark, zips, tmp_path):
    from spinward.__main__ import main

    main(["coverage", f"{zips}/data_Q1_2023.zip", f"{zips}/data_Q2_2023.zip", "--out", str(tmp_path / "cover"), "--columns-out", str(tmp_path / "cols"), "--models-out", str(tmp_path / "models"), "--min-coverage", "50"])
    locked = [r.value for r in spark.read.text(str(tmp_path / "cols")).collect()]
    assert set(C.ID_COLUMNS) <= set(locked) and "smart_5_raw" in locked
    main(["dataset", f"{zips}/data_Q1_2023.zip", f"{zips}/data_Q2_2023.zip", "--columns", str(tmp_path / "cols"), "--out-dir", str(tmp_path / "data")])
    main(["modeling", "--in-dir", str(tmp_path / "data"), "--out-dir", str(tmp_path / "model")])
    assert spark.read.schema("split string").parquet(str(tmp_path / "model")).count() >= 0


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    from spinward.streaming.windows import stream_windows

    grid = W.Grid("2024-01-01", 3, "2024-01-19", "2024-01-25")
    rows = spark.range(300).select((F.col("id") % 5).cast("string").alias("serial_number"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id, 0, 0)").alias("ts"), (F.col("id") * 1.5).alias("s"), (F.col("id") % 97 == 96).cast("int").alias("failure"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream_windows(stream, ["s"], grid).writeStream.outputMode("complete").format("memory").queryName("spans").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.serial_number, r.window): (r.s_first, r.s_last, r.failed_in_window) for r in spark.table("spans").collect()}
    batch = {(r.serial_number, r.window): (r.a, r.b, r.f) for r in W.with_window(rows.withColumn("date", F.to_date("ts")), grid).groupBy("serial_number", "window").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.max("failure").alias("f")).collect()}
    assert got == batch and len(got) == 25


def test_models_save_load_and_rank(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    from spinward.operators import models as L

    rng = np.random.default_rng(2)
    rows = [(f"d{i}", int(i % 12), int(i % 4 == 0), float(i % 4 == 0) * 2 + rng.normal(), None if i % 9 == 0 else rng.normal(), "ST4000" if i % 2 else "WDC") for i in range(480)]
    data = spark.createDataFrame(rows, "serial_number string, window int, label int, a double, b double, model string").withColumn("vendor", C.vendor(F.col("model"))).cache()
    train, valid = L.prepared(data.where("window < 8"), [data.where("window >= 8")], ["a", "b"])
    model = L.logistic()(train)
    assert L.evaluate(L.predict(model, valid))["pr_auc"] > 0.6
    model.write().overwrite().save(str(tmp_path / "lr"))
    again = LogisticRegressionModel.load(str(tmp_path / "lr"))
    assert L.predict(again, valid).exceptAll(L.predict(model, valid)).count() == 0
    kernel = L.KernelMap(0.2, 30).fit(train, ["serial_number", "window"])
    assert L.evaluate(L.predict(L.svm()(kernel.apply(train)), kernel.apply(valid)), 0.0)["pr_auc"] > 0.5
    ranked = L.search(data, L.tree, {"max_depth": [1, 3], "min_leaf": [5]}, ["a", "b"], n_folds=2, log=False, scale=False).collect()
    assert [r.pr_auc_rank for r in ranked] == [1, 2] or ranked[0].pr_auc == ranked[1].pr_auc
