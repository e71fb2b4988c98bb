"""Every query over the supplied tables by name, each with independent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinward.functions import columns as C
from spinward.operators import audit as A
from spinward.operators import features as X
from spinward.operators import metrics as M
from spinward.operators import profile as P
from spinward.operators import rates as R
from spinward.operators import stats as S
from spinward.operators import windows as W
from spinward.operators.ranks import top_n
from spinward.plans import standins as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _bigint_counts(sql: str) -> str:
    """count_if gives a HUGEINT in DuckDB; our counts are BIGINT."""
    out, at = "", 0
    while (start := sql.find("count_if(", at)) >= 0:
        depth, end = 0, start + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if depth == 0:
                break
        out += sql[at:start] + f"CAST({sql[start:end]} AS BIGINT)"
        at = end
    return out + sql[at:]


def query(sql: str | None = None, digits: int | None = 6):
    """Registers a query; doubles are rounded, as sums of doubles depend on their order."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(c, digits).alias(c) if kind == "double" and digits is not None else F.col(f"`{c}`") for c, kind in df.dtypes])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = _bigint_counts(sql)
        return f

    return add


def y() -> Column:
    return F.col("label").cast("int")


def returned() -> Column:
    return (F.col("l_returnflag") == "R").cast("int")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "lineitem")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["modeling_table"](spark, sf_dir)


# --- calendar windows


@query(f"WITH {D.DAILY_SQL} SELECT serial_number, date, round(smart_5_raw, 6) AS smart_5_raw, round(smart_9_raw, 6) AS smart_9_raw, round(smart_197_raw, 6) AS smart_197_raw, failure, model, capacity_bytes FROM daily")
def daily_rollup(spark, sf):
    return D.daily(spark, sf)


@query(f'WITH {D.WINDOWS_SQL} SELECT serial_number, date, "window" FROM grid')
def grid_index(spark, sf):
    return W.with_window(D.daily(spark, sf), D.GRID).select("serial_number", "date", "window")


_ENDS = ", ".join(f"round({s}_{e}, 6) AS {s}_{e}" for s in D.SENSORS for e in ("first", "last"))
_DELTAS = ", ".join(f"round({s}_delta, 6) AS {s}_delta" for s in D.SENSORS)
_WHOLE = f'serial_number, "window", {_ENDS}, window_first_date, window_last_date, days_observed, capacity_bytes, model, days_span, {_DELTAS}'


@query(f"WITH {D.WINDOWS_SQL} SELECT {_WHOLE}, failed_in_window FROM win")
def window_aggregate(spark, sf):
    return D.windows(spark, sf)


@query(f'WITH {D.WINDOWS_SQL} SELECT serial_number, "window", days_span, {_DELTAS} FROM win')
def window_span_delta(spark, sf):
    return D.windows(spark, sf).select("serial_number", "window", "days_span", *[f"{s}_delta" for s in D.SENSORS])


@query(f'WITH {D.LABELLED_SQL} SELECT serial_number, "window", label FROM lab')
def next_window_label(spark, sf):
    return D.labelled(spark, sf).select("serial_number", "window", "label")


@query(f'WITH {D.WINDOWS_SQL} SELECT a.serial_number, a."window", b.failed_in_window AS label FROM win a JOIN win b ON a.serial_number = b.serial_number AND b."window" = a."window" + 1')
def label_by_self_join(spark, sf):
    return W.label_by_join(D.windows(spark, sf))


@query(f'WITH {D.LABELLED_SQL} SELECT serial_number, "window", drive_days_to_date FROM lab')
def exposure_to_date(spark, sf):
    return D.labelled(spark, sf).select("serial_number", "window", "drive_days_to_date")


@query(f'WITH {D.LABELLED_SQL} SELECT serial_number, "window", days_observed, label FROM lab WHERE days_observed >= 2')
def min_days_after_label(spark, sf):
    return W.enough_days(D.labelled(spark, sf), D.GRID).select("serial_number", "window", "days_observed", "label")


@query(f'WITH {D.ROWS_SQL} SELECT serial_number, "window", split FROM rws')
def split_buffer(spark, sf):
    return D.rows(spark, sf).select("serial_number", "window", "split")


@query(f'WITH {D.STRICT_SQL} SELECT serial_number, "window", split FROM strict')
def strict_buffer(spark, sf):
    return W.split_windows(W.enough_days(D.labelled(spark, sf), D.GRID), D.GRID, strict=True).select("serial_number", "window", "split")


@query(f'WITH {D.SAMPLED_SQL} SELECT serial_number, "window", split, label FROM smp')
def sample_negatives_md5(spark, sf):
    return W.sample_negatives(D.rows(spark, sf), D.GRID).select("serial_number", "window", "split", "label")


@query(f"""WITH {D.SAMPLED_SQL} SELECT serial_number, "window", split FROM smp
    WHERE split = 'train' OR serial_number NOT IN (SELECT serial_number FROM smp WHERE split = 'train')""")
def strict_grouping_anti(spark, sf):
    return W.strict_grouping(W.sample_negatives(D.rows(spark, sf), D.GRID)).select("serial_number", "window", "split")


@query(f"WITH {D.SAMPLED_SQL} SELECT {_WHOLE}, label, drive_days_to_date, split FROM smp")
def modeling_table(spark, sf):
    return W.modeling_table(D.daily(spark, sf), D.GRID)


@query(f"""WITH {D.SAMPLED_SQL} SELECT split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, CAST(CASE WHEN sum(label) > 0 THEN count(*) // CAST(sum(label) AS BIGINT) END AS BIGINT) AS one_in,
    min(window_first_date) AS first_date, max(window_last_date) AS last_date, count(DISTINCT serial_number) AS devices, count(DISTINCT "window") AS windows FROM smp GROUP BY split""")
def split_summary(spark, sf):
    return W.split_summary(W.modeling_table(D.daily(spark, sf), D.GRID))


@query(f"""WITH {D.ROWS_SQL} SELECT split, "window", count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS failures, min(window_first_date) AS first_date FROM rws GROUP BY split, "window" """)
def calendar_coverage(spark, sf):
    return D.rows(spark, sf).groupBy("split", "window").agg(F.count("*").alias("n_rows"), F.sum(y()).alias("failures"), F.min("window_first_date").alias("first_date"))


# --- profiles

_PARTS = ["Q1", "Q2", "Q3", "Q4"]


def profiled(spark, sf) -> DataFrame:
    """Events with parts by week and columns that are filled to different degrees; one is missing from a part's header."""
    e = D.read(spark, sf, "events")
    part = F.concat(F.lit("Q"), F.least(F.lit(4), F.floor((F.dayofmonth("ts") - 1) / 8) + 1).cast("string"))
    return e.select(part.alias("quarter"), F.col("event_type").alias("model"), F.col("value").alias("smart_1_raw"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("smart_5_raw"), F.when(F.col("event_id") % 20 != 0, F.col("value")).alias("smart_9_raw"), F.when(F.col("event_id") % 200 == 0, F.col("value")).alias("smart_187_raw"))


_COLS = ["model", "smart_1_raw", "smart_5_raw", "smart_9_raw", "smart_187_raw"]
_PROFILED = """prof AS (SELECT 'Q' || CAST(least(4, (dayofmonth(ts) - 1) // 8 + 1) AS VARCHAR) AS quarter, event_type AS model, value AS smart_1_raw, CASE WHEN event_id % 7 <> 0 THEN value END AS smart_5_raw,
    CASE WHEN event_id % 20 <> 0 THEN value END AS smart_9_raw, CASE WHEN event_id % 200 = 0 THEN value END AS smart_187_raw FROM events)"""
_COUNTS = _PROFILED + ", cnt AS (" + " UNION ALL ".join(f"SELECT quarter, '{c}' AS \"column\", count({c}) AS non_null_rows, count(*) AS total_rows FROM prof GROUP BY quarter" for c in _COLS) + ")"
_COVER = _COUNTS + """, cover AS (SELECT "column", CAST(sum(non_null_rows) AS BIGINT) AS non_null_rows, CAST(sum(total_rows) AS BIGINT) AS total_rows,
    round_even(100.0 * sum(non_null_rows) / sum(total_rows), 2) AS coverage_pct, starts_with("column", 'smart_') AS is_smart FROM cnt GROUP BY "column")"""
_HEADERS = _COUNTS + """, headers AS (SELECT DISTINCT quarter, "column" FROM cnt WHERE NOT ("column" = 'smart_9_raw' AND quarter = 'Q2') AND NOT ("column" = 'smart_187_raw' AND quarter IN ('Q1', 'Q4')))"""


def headers(spark) -> DataFrame:
    lacks = {("Q2", "smart_9_raw"), ("Q1", "smart_187_raw"), ("Q4", "smart_187_raw")}
    return spark.createDataFrame([(q, c) for q in _PARTS for c in _COLS if (q, c) not in lacks], "quarter string, column string")


@query(f'WITH {_COVER} SELECT "column", non_null_rows, total_rows, CAST(coverage_pct AS DOUBLE) AS coverage_pct, is_smart FROM cover')
def null_coverage(spark, sf):
    return P.coverage(P.non_null_counts(profiled(spark, sf), _COLS))


@query(f'WITH {_COUNTS} SELECT quarter, "column", non_null_rows, total_rows FROM cnt')
def coverage_by_part(spark, sf):
    return P.non_null_counts(profiled(spark, sf), _COLS, ["quarter"])


@query(f"""WITH {_HEADERS}, q AS (SELECT unnest(['Q1', 'Q2', 'Q3', 'Q4']) AS quarter), seen AS (SELECT "column", count(DISTINCT quarter) AS n FROM headers GROUP BY "column" HAVING count(DISTINCT quarter) < 4)
    SELECT s."column", s.n AS quarters_present, string_agg(q.quarter, ' ' ORDER BY q.quarter) AS missing_from FROM seen s, q WHERE NOT EXISTS (SELECT 1 FROM headers h WHERE h."column" = s."column" AND h.quarter = q.quarter) GROUP BY 1, 2""")
def presence_report(spark, sf):
    return P.presence(headers(spark), _PARTS)


@query(f"""WITH {_HEADERS}, cover AS (SELECT "column", 100.0 * sum(non_null_rows) / sum(total_rows) AS pct FROM cnt GROUP BY "column")
    SELECT "column" FROM cover WHERE (SELECT count(DISTINCT quarter) FROM headers h WHERE h."column" = cover."column") = 4 AND ("column" = 'model' OR pct >= 85)""")
def locked_columns(spark, sf):
    return P.locked_columns(P.coverage(P.non_null_counts(profiled(spark, sf), _COLS)), headers(spark), _PARTS, required=["model"], min_coverage=85)


@query(f'WITH {_COVER} SELECT count(*) AS columns, count_if(coverage_pct > 90) AS over_90, count_if(coverage_pct > 50) AS over_50, count_if(coverage_pct < 1) AS under_1 FROM cover')
def coverage_counters(spark, sf):
    return P.coverage_counters(P.coverage(P.non_null_counts(profiled(spark, sf), _COLS)))


@query("SELECT event_type AS model, count(*) AS drive_days FROM events GROUP BY 1")
def model_counts(spark, sf):
    return P.model_counts(D.read(spark, sf, "events").select(F.col("event_type").alias("model")))


@query("""WITH p AS (SELECT *, regexp_matches(p_name, '(?i)red|bolt') AS hit FROM part)
    SELECT coalesce(p_type, 'TOTAL') AS p_type, count(*) AS rows_in, count_if(NOT hit) AS rows_kept, count_if(hit) AS rows_dropped, round(100.0 * count_if(hit) / count(*), 3) AS dropped_pct, count_if(NOT hit AND p_size > 45) AS failures,
    CAST(CASE WHEN count_if(NOT hit AND p_size > 45) > 0 THEN count_if(NOT hit) // count_if(NOT hit AND p_size > 45) END AS BIGINT) AS one_in FROM p GROUP BY ROLLUP (p_type)""")
def quarter_rollup_report(spark, sf):
    return P.quarter_report(D.read(spark, sf, "part"), "p_type", dropped=C.has_marker(F.col("p_name"), ("red", "bolt")), failed=F.col("p_size") > 45)


@query("SELECT p_partkey, p_name FROM part WHERE NOT coalesce(regexp_matches(p_name, '(?i)RED|bolt'), false)")
def substring_exclusion(spark, sf):
    return D.read(spark, sf, "part").where(~C.has_marker(F.col("p_name"), ("RED", "bolt"))).select("p_partkey", "p_name")


@query("SELECT count(*) AS n_rows, count_if(regexp_matches(p_name, '(?i)red')) AS marked, round(100.0 * count_if(regexp_matches(p_name, '(?i)red')) / count(*), 6) AS marked_pct FROM part")
def marked_share(spark, sf):
    return P.marked_share(D.read(spark, sf, "part"), F.col("p_name"), ("red",))


@query(f"WITH {D.DAILY_SQL} SELECT serial_number, date, {D.VENDOR_SQL.format('model')} AS vendor FROM daily")
def prefix_vendor(spark, sf):
    return D.daily(spark, sf).select("serial_number", "date", C.vendor(F.col("model")).alias("vendor"))


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf):
    return lineitem(spark, sf).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_shipdate < TIMESTAMP '1999-01-01'")
def pruned_scan(spark, sf):
    return lineitem(spark, sf).where((F.col("l_quantity") >= 30) & (F.col("l_shipdate") < "1999-01-01")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(c_acctbal, 6) END AS known, round_even(CASE WHEN c_acctbal > 0 THEN c_acctbal END / 1e3, 0) AS thousands FROM customer")
def capacity_sentinel(spark, sf):
    known = C.known_capacity(F.col("c_acctbal"))
    return D.read(spark, sf, "customer").select("c_custkey", known.alias("known"), F.bround(known / 1e3, 0).alias("thousands"))


@query(f"WITH {D.WINDOWS_SQL} SELECT serial_number, \"window\", round(coalesce(smart_197_raw_last, 0), 6) AS filled FROM win WHERE smart_5_raw_last IS NOT NULL")
def drop_and_fill_nulls(spark, sf):
    w = D.windows(spark, sf).na.drop(subset=["smart_5_raw_last"])
    return w.na.fill(0.0, ["smart_197_raw_last"]).select("serial_number", "window", F.col("smart_197_raw_last").alias("filled"))


# --- keys and sets


@query(f"""WITH {D.SAMPLED_SQL}, k AS (SELECT serial_number, max(CAST(split = 'train' AS INT)) AS a, max(CAST(split = 'calib' AS INT)) AS b, max(CAST(split = 'test' AS INT)) AS c FROM smp GROUP BY 1)
    SELECT CAST(sum(a * b) AS BIGINT) AS train_calib, CAST(sum(a * c) AS BIGINT) AS train_test, CAST(sum(b * c) AS BIGINT) AS calib_test, CAST(sum(c * (1 - a)) AS BIGINT) AS test_not_train FROM k""")
def split_overlap(spark, sf):
    return P.overlap(W.modeling_table(D.daily(spark, sf), D.GRID), "serial_number", "split", ("train", "calib", "test"))


@query("SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT) AS duplicates FROM lineitem")
def duplicate_keys(spark, sf):
    return P.duplicates(lineitem(spark, sf), ["l_orderkey", "l_linenumber"])


@query("""SELECT (SELECT count(*) FROM (SELECT o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_custkey, 'F' FROM orders)) AS only_left,
    (SELECT count(*) FROM (SELECT o_custkey, 'F' FROM orders EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders)) AS only_right""")
def frame_diff(spark, sf):
    o = D.read(spark, sf, "orders")
    return P.same_rows(o.select("o_custkey", "o_orderstatus"), o.select("o_custkey", F.lit("F").alias("o_orderstatus")))


@query(f"""WITH {D.ROWS_SQL} SELECT serial_number, "window", CAST(1 AS INTEGER) AS side FROM rws WHERE label = 1 UNION ALL SELECT serial_number, "window", CAST(0 AS INTEGER) FROM rws WHERE label = 0""")
def union_pos_neg(spark, sf):
    r = D.rows(spark, sf).select("serial_number", "window", "label")
    pos, neg = (r.where(F.col("label") == k).select("serial_number", "window", F.lit(k).alias("side")) for k in (1, 0))
    return pos.unionByName(neg)


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect_keys(spark, sf):
    o = D.read(spark, sf, "orders").select("o_orderstatus", F.col("o_custkey").alias("k"))
    return o.where("o_orderstatus = 'F'").select("k").intersect(o.where("o_orderstatus = 'O'").select("k"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(spark, sf):
    return D.read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(D.read(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)")
def semi_membership(spark, sf):
    o = D.read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    big = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")
    return o.join(big, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


# --- rates


@query("""SELECT l_suppkey, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS failures, count(DISTINCT l_orderkey) AS devices, round(sum(l_quantity) / 365.0, 6) AS device_years,
    round(100.0 * count_if(l_returnflag = 'R') / (sum(l_quantity) / 365.0), 6) AS afr_pct FROM lineitem GROUP BY 1""")
def afr_by_group(spark, sf):
    return R.afr_table(lineitem(spark, sf), ["l_suppkey"], returned(), F.col("l_quantity"), "l_orderkey")


@query("SELECT CAST(count_if(l_returnflag = 'R') AS BIGINT) AS failures, round(sum(l_quantity) / 365.0, 6) AS device_years, round(100.0 * count_if(l_returnflag = 'R') / (sum(l_quantity) / 365.0), 6) AS afr_pct FROM lineitem")
def afr_overall(spark, sf):
    return R.afr_table(lineitem(spark, sf), [], returned(), F.col("l_quantity"))


@query("SELECT l_linestatus, " + ", ".join(f"count_if(l_returnflag = '{v}') AS l_returnflag_{v}" for v in "ANR") + " FROM lineitem GROUP BY 1")
def crosstab_counts(spark, sf):
    return R.crosstab(lineitem(spark, sf), "l_linestatus", "l_returnflag", list("ANR"))


_AGE = "CASE " + " ".join(f"WHEN age >= {a} AND age < {b} THEN '[{a}, {b})'" for a, b in zip(C.AGE_EDGES, C.AGE_EDGES[1:], strict=False)) + " END"


@query(f"""WITH l AS (SELECT l_quantity / 4.0 AS age, l_quantity, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), b AS (SELECT {_AGE} AS age_bin, l_quantity, y FROM l)
    SELECT age_bin, CAST(sum(y) AS BIGINT) AS failures, round(sum(l_quantity) / 365.0, 6) AS device_years, round(100.0 * sum(y) / (sum(l_quantity) / 365.0), 6) AS afr_pct FROM b WHERE age_bin IS NOT NULL GROUP BY 1""")
def age_bins_left_closed(spark, sf):
    li = lineitem(spark, sf).withColumn("age_bin", C.left_closed_bin(F.col("l_quantity") / 4.0)).na.drop(subset=["age_bin"])
    return R.afr_table(li, ["age_bin"], returned(), F.col("l_quantity"))


@query("""WITH b AS (SELECT CASE WHEN v > 512.5 THEN '>512' WHEN v > 64.5 THEN '65-512' WHEN v > 8.5 THEN '9-64' WHEN v > 1.5 THEN '2-8' WHEN v > 0.5 THEN '1' WHEN v > -0.5 THEN '0' END AS bucket, y FROM (SELECT value AS v, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events))
    SELECT bucket, CAST(sum(y) AS BIGINT) AS failures, count(*) AS n FROM b GROUP BY 1""")
def value_buckets_right_closed(spark, sf):
    e = D.read(spark, sf, "events").withColumn("bucket", C.value_bucket(F.col("value")))
    return e.groupBy("bucket").agg(F.sum((F.col("event_type") == "error").cast("int")).alias("failures"), F.count("*").alias("n"))


@query("""SELECT l_linestatus, round(count_if(l_returnflag = 'R') / (count_if(l_returnflag = 'R') + 36.05 * count_if(l_returnflag <> 'R')), 6) AS rate FROM lineitem GROUP BY 1""")
def reweighted_rate(spark, sf):
    return R.reweighted_rate(lineitem(spark, sf), returned(), 721 / 20, ["l_linestatus"])


_LIFT = [f"{s}_delta" for s in D.SENSORS]


@query(f"WITH {D.LABELLED_SQL} " + " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(avg(CASE WHEN label = 1 THEN CAST(coalesce({c} > 0, false) AS INT) END), 6) AS share_failed,
    round(avg(CASE WHEN label = 0 THEN CAST(coalesce({c} > 0, false) AS INT) END), 6) AS share_healthy,
    round(avg(CASE WHEN label = 1 THEN CAST(coalesce({c} > 0, false) AS INT) END) / greatest(avg(CASE WHEN label = 0 THEN CAST(coalesce({c} > 0, false) AS INT) END), 1e-6), 6) AS lift FROM lab""" for c in _LIFT))
def lift(spark, sf):
    return R.lift_table(D.labelled(spark, sf), _LIFT, y())


@query(f"""WITH {D.DAILY_SQL} SELECT model, count_if(smart_197_raw IS NULL) AS smart_197_raw_missing, round(avg(CAST(smart_197_raw IS NULL AS INT)), 6) AS smart_197_raw_missing_share,
    count_if(smart_5_raw IS NULL) AS smart_5_raw_missing, round(avg(CAST(smart_5_raw IS NULL AS INT)), 6) AS smart_5_raw_missing_share FROM daily GROUP BY model""")
def missing_by_model(spark, sf):
    return R.missing_by_group(D.daily(spark, sf), "model", ["smart_197_raw", "smart_5_raw"])


@query("SELECT l_suppkey, count(*) AS n, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY 1 HAVING count(*) > 580")
def having_filter(spark, sf):
    return lineitem(spark, sf).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean_discount")).where("n > 580")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 15")
def topk_groups(spark, sf):
    return top_n(lineitem(spark, sf).groupBy("l_partkey").agg(F.count("*").alias("n")), 15, "n", ["l_partkey"])


@query("""SELECT l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_mean FROM lineitem GROUP BY 1""")
def weighted_mean(spark, sf):
    return R.weighted_mean(lineitem(spark, sf), "l_discount", "l_quantity", ["l_linestatus"])


@query("""WITH g AS (SELECT l_suppkey, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS k, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, k / CAST(n AS DOUBLE) AS p FROM g)
    SELECT l_suppkey, k, n, round(p, 6) AS rate, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS low,
    round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM p""")
def wilson(spark, sf):
    return R.wilson_table(lineitem(spark, sf), ["l_suppkey"], returned())


# --- statistics


def _chi2_sql(rows: str, cols: str, yates: bool) -> str:
    gap = "greatest(abs(x - e) - least(0.5, abs(x - e)), 0)" if yates else "abs(x - e)"
    return f"""WITH c AS (SELECT {rows} AS r, {cols} AS c, count(*) AS x FROM lineitem GROUP BY 1, 2), g AS (SELECT r.r, c.c, coalesce(x.x, 0) AS x FROM (SELECT DISTINCT r FROM c) r CROSS JOIN (SELECT DISTINCT c FROM c) c LEFT JOIN c x ON x.r = r.r AND x.c = c.c),
        t AS (SELECT *, sum(x) OVER (PARTITION BY r) * sum(x) OVER (PARTITION BY c) / CAST(sum(x) OVER () AS DOUBLE) AS e FROM g), s AS (SELECT sum(pow({gap}, 2) / e) AS chi2, sum(x) AS n, count(DISTINCT r) AS nr, count(DISTINCT c) AS nc FROM t)
        SELECT round(chi2, 6) AS chi2, CAST((nr - 1) * (nc - 1) AS BIGINT) AS dof, round(sqrt(chi2 / (n * (least(nr, nc) - 1))), 6) AS cramers_v, CAST(n AS BIGINT) AS n FROM s"""


@query(_chi2_sql("l_suppkey", "l_returnflag", False))
def chi2_cramers_v(spark, sf):
    return S.chi_square(R.crosstab(lineitem(spark, sf), "l_suppkey", "l_returnflag", list("ANR")), [f"l_returnflag_{v}" for v in "ANR"])


@query(_chi2_sql("l_linestatus", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", True))
def chi2_yates(spark, sf):
    li = lineitem(spark, sf).withColumn("y", returned())
    return S.chi_square(R.crosstab(li, "l_linestatus", "y", [0, 1]), ["y_0", "y_1"])


_OR = " UNION ALL ".join(f"""SELECT '{c}' AS feature, count_if({c} > 0 AND label = 1) AS a, count_if({c} > 0 AND label = 0) AS b, count_if({c} = 0 AND label = 1) AS c, count_if({c} = 0 AND label = 0) AS d FROM t""" for c in ("smart_9_raw_last", "changed"))


@query(f"""WITH {D.LABELLED_SQL}, t AS (SELECT label, smart_9_raw_last, CASE WHEN smart_5_raw_delta > 0 THEN 1.0 ELSE 0.0 END AS changed FROM lab), u AS ({_OR}), h AS (SELECT *, a + 0.5 AS p, b + 0.5 AS q, c + 0.5 AS r, d + 0.5 AS s FROM u)
    SELECT feature, a, b, c, d, round(CAST(p * s / (q * r) AS DOUBLE), 5) AS odds_ratio, round(exp(ln(p * s / (q * r)) - 1.96 * sqrt(1 / p + 1 / q + 1 / r + 1 / s)), 5) AS low, round(exp(ln(p * s / (q * r)) + 1.96 * sqrt(1 / p + 1 / q + 1 / r + 1 / s)), 5) AS high FROM h""", digits=5)
def odds_ratio_ci(spark, sf):
    t = D.labelled(spark, sf).select("label", "smart_9_raw_last", F.when(F.col("smart_5_raw_delta") > 0, 1.0).otherwise(0.0).alias("changed"))
    return S.odds_ratios(t, ["smart_9_raw_last", "changed"], y())


_LASTS = [f"{s}_last" for s in D.SENSORS]


def _rho_sql(a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return f"SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM lab WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


_RHO = " UNION ALL ".join(_rho_sql(a, b) for i, a in enumerate(_LASTS) for b in _LASTS[i + 1 :])


@query(f"WITH {D.LABELLED_SQL} {_RHO}")
def spearman(spark, sf):
    return S.spearman(D.labelled(spark, sf), _LASTS)


@query(f"WITH {D.LABELLED_SQL}, rho AS ({_RHO}) SELECT * FROM rho WHERE abs(rho) >= 0.5 ORDER BY abs(rho) DESC, a, b LIMIT 12")
def redundant_pairs(spark, sf):
    return S.redundant_pairs(S.spearman(D.labelled(spark, sf), _LASTS), 0.5)


@query("""WITH r AS (SELECT event_type AS g, value AS v, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events),
    s AS (SELECT g, count(*) AS n, sum(r) AS r FROM r GROUP BY g), t AS (SELECT sum(n) AS n, sum(r * r / n) AS s, count(*) - 1 AS dof FROM s), k AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM events GROUP BY value))
    SELECT round((12.0 / (n * (n + 1.0)) * s - 3 * (n + 1.0)) / (1 - ties / (pow(CAST(n AS DOUBLE), 3) - n)), 5) AS h, CAST(dof AS BIGINT) AS dof, CAST(n AS BIGINT) AS n FROM t, k""", digits=5)
def kruskal_h(spark, sf):
    return S.kruskal_wallis(D.read(spark, sf, "events"), "value", "event_type")


def _auc_sql(value: str, source: str, label: str = "label", where: str = "TRUE") -> str:
    return f"""(SELECT (sum(CASE WHEN y = 1 THEN r END) - p * (p + 1) / 2.0) / (p * q) FROM (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, CAST(sum(y) OVER () AS DOUBLE) AS p, CAST(sum(1 - y) OVER () AS DOUBLE) AS q
        FROM (SELECT {value} AS v, CAST({label} AS INT) AS y FROM {source} WHERE {value} IS NOT NULL AND {where})) GROUP BY p, q)"""


def _oriented(sql: str) -> str:
    return f"coalesce(greatest({sql}, 1 - {sql}), 0.5)"


_ALL = [f"{s}_{e}" for s in D.SENSORS for e in ("last", "delta")]


@query(f"WITH {D.LABELLED_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round({_oriented(_auc_sql(c, 'lab'))}, 6) AS auc" for c in _ALL))
def oriented_auc(spark, sf):
    return S.oriented_aucs(D.labelled(spark, sf), _ALL, y())


@query(f"""WITH {D.LABELLED_SQL}, v AS (SELECT {D.VENDOR_SQL.format('model')} AS vendor, smart_5_raw_last AS x, CAST(label AS INT) AS y FROM lab WHERE smart_5_raw_last IS NOT NULL), k AS (SELECT * FROM v WHERE vendor <> 'Other'),
    r AS (SELECT vendor, y, rank() OVER (PARTITION BY vendor ORDER BY x) + (count(*) OVER (PARTITION BY vendor, x) - 1) / 2.0 AS r FROM k),
    a AS (SELECT vendor, sum(y) AS p, count(*) - sum(y) AS q, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(CAST(sum(y) AS DOUBLE) * (count(*) - sum(y)), 0) AS auc FROM r GROUP BY vendor HAVING sum(y) >= 5)
    SELECT round(sum(coalesce(greatest(auc, 1 - auc), 0.5) * (p + q)) / sum(p + q), 6) AS auc, count(*) AS groups FROM a""")
def within_group_auc(spark, sf):
    rows = D.labelled(spark, sf).withColumn("vendor", C.vendor(F.col("model")))
    return S.within_group_auc(rows, "smart_5_raw_last", y(), "vendor", least_positives=5)


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 5) AS z FROM events", digits=5)
def zscore(spark, sf):
    e = D.read(spark, sf, "events").select("event_id", "value")
    m = e.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return e.crossJoin(F.broadcast(m)).select("event_id", ((F.col("value") - F.col("m")) / F.col("s")).alias("z"))  # one row


def _moments_sql(x: str, source: str) -> str:
    m = f"(SELECT avg({x}) AS m, stddev_pop({x}) AS s FROM {source})"
    return f"SELECT avg(pow(({x} - m) / s, 3)) AS skew, avg(pow(({x} - m) / s, 4)) - 3 AS kurtosis, greatest(max({x}) - avg({x}), avg({x}) - min({x})) / stddev_samp({x}) AS max_abs_z, avg(CAST({x} = 0 AS INT)) AS zero_share FROM {source}, {m}"


@query("SELECT 'value' AS feature, round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis, round(max_abs_z, 5) AS max_abs_z, round(zero_share, 5) AS zero_share FROM (" + _moments_sql("value", "events") + ")", digits=5)
def moments(spark, sf):
    return S.moments(D.read(spark, sf, "events"), ["value"])


@query("SELECT event_id, round(CASE WHEN value IS NOT NULL THEN ln(1 + greatest(value - 50, 0)) END, 6) AS v FROM events")
def log1p_clip(spark, sf):
    return D.read(spark, sf, "events").select("event_id", C.log1p_clip(F.col("value") - 50).alias("v"))


@query("""WITH t AS (SELECT l_extendedprice AS a, l_discount AS b FROM lineitem), c AS (SELECT b, count(*) AS n FROM t GROUP BY b)
    SELECT 'l_extendedprice' AS raw, 'l_discount' AS other, (SELECT count(DISTINCT a) FROM t) AS raw_levels, (SELECT count(DISTINCT b) FROM t) AS levels,
    round((SELECT count(DISTINCT a) FROM t) / CAST((SELECT count(DISTINCT b) FROM t) AS DOUBLE), 6) AS ratio, (SELECT b FROM c ORDER BY n DESC, b LIMIT 1) AS mode, round((SELECT max(n) / CAST(sum(n) AS DOUBLE) FROM c), 6) AS mode_share""")
def distinct_levels(spark, sf):
    return S.distinct_levels(lineitem(spark, sf), [("l_extendedprice", "l_discount")])


@query("SELECT l_returnflag, CAST(floor(least((l_quantity - 0) / 5.0, 9)) AS INTEGER) AS bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY l_returnflag) * 5.0), 6) AS density FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2")
def histogram(spark, sf):
    return S.histogram(lineitem(spark, sf), "l_quantity", 0.0, 50.0, 10, ["l_returnflag"])


@query("""WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)
    SELECT l_returnflag, l_quantity, n, round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / CAST(sum(n) OVER (PARTITION BY l_returnflag) AS DOUBLE), 6) AS share_to FROM c""")
def ecdf(spark, sf):
    return S.ecdf(lineitem(spark, sf), "l_quantity", "l_returnflag")


@query(f"WITH {D.LABELLED_SQL} SELECT {D.VENDOR_SQL.format('model')} AS vendor, " + ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS {c}_median" for c in _LASTS) + " FROM lab GROUP BY 1")
def group_medians(spark, sf):
    return S.group_medians(D.labelled(spark, sf).withColumn("vendor", C.vendor(F.col("model"))), "vendor", _LASTS)


def _describe_sql(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, round(min({c}), 5) AS min, round(quantile_cont({c}, 0.25), 5) AS p25, round(quantile_cont({c}, 0.5), 5) AS p50, round(quantile_cont({c}, 0.75), 5) AS p75, round(max({c}), 5) AS max FROM lineitem"


@query(_describe_sql("l_quantity") + " UNION ALL " + _describe_sql("l_extendedprice"), digits=5)
def describe_numeric(spark, sf):
    return P.describe(lineitem(spark, sf), ["l_quantity", "l_extendedprice"])


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('#', 7, event_id)), event_id) AS r FROM events) WHERE r <= 40")
def stratified_sample(spark, sf):
    return S.stratified_sample(D.read(spark, sf, "events").select("event_type", "event_id"), "event_type", 40, ["event_id"])


@query(f"WITH {D.LABELLED_SQL} " + " UNION ALL ".join(f"""SELECT '{s}_last' AS level, '{s}_delta' AS change, round({_oriented(_auc_sql(s + '_last', 'lab'))}, 6) AS auc_level, round({_oriented(_auc_sql(s + '_delta', 'lab'))}, 6) AS auc_change,
    round((SELECT avg(CAST(coalesce({s}_delta > 0, false) AS INT)) FROM lab WHERE label = 1), 6) AS share_failed, round((SELECT avg(CAST(coalesce({s}_delta > 0, false) AS INT)) FROM lab WHERE label = 0), 6) AS share_healthy,
    round((SELECT avg(CAST(coalesce({s}_delta > 0, false) AS INT)) FROM lab WHERE label = 1) / greatest((SELECT avg(CAST(coalesce({s}_delta > 0, false) AS INT)) FROM lab WHERE label = 0), 1e-6), 6) AS lift""" for s in D.SENSORS[:2]))
def signal_table(spark, sf):
    return S.signal_table(D.labelled(spark, sf), [(f"{s}_last", f"{s}_delta") for s in D.SENSORS[:2]], y())


@query("WITH t AS (SELECT value AS x, ln(1 + greatest(value, 0)) AS l, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events) " + " UNION ALL ".join(f"SELECT 'value' AS feature, '{n}' AS form, round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis, round({_oriented(_auc_sql(c, 't'))}, 5) AS auc FROM ({_moments_sql(c, 't')})" for n, c in (("raw", "x"), ("log1p", "l"))), digits=5)
def transform_table(spark, sf):
    return S.transform_table(D.read(spark, sf, "events"), ["value"], (F.col("event_type") == "error").cast("int"))


@query()
def poisson_ci(spark, sf):
    return R.with_poisson_limits(R.afr_table(lineitem(spark, sf), ["l_linestatus"], returned(), F.col("l_quantity")))


@query()
def mutual_information(spark, sf):
    return S.mutual_information(D.labelled(spark, sf), _LASTS, "label", keys=["serial_number", "window"])


@query()
def feature_catalogue(spark, sf):
    return P.feature_catalogue(D.rows(spark, sf))


# --- audit

_CHECKS = f"""WITH {D.SAMPLED_SQL}, n AS (SELECT count_if(label = 0) AS neg, count_if(label = 1) AS pos FROM smp WHERE split = 'train'),
    mx AS (SELECT *, max("window") OVER (PARTITION BY serial_number) AS mw FROM win), last AS (SELECT count_if("window" = mw) / CAST(nullif(count(*), 0) AS DOUBLE) AS x FROM mx WHERE failed_in_window = 1),
    miss AS (SELECT greatest(avg(CAST(smart_5_raw_last IS NULL AS INT)), avg(CAST(smart_9_raw_last IS NULL AS INT))) AS x, count_if(smart_5_raw_last < 0) + count_if(smart_9_raw_last < 0) AS neg, avg(CAST(smart_9_raw_last BETWEEN 0 AND 100 AS INT)) AS r FROM smp),
    c AS ({" UNION ALL ".join(f"SELECT 'unique keys in {s}' AS \"check\", (SELECT count(*) - count(DISTINCT serial_number || '#' || \"window\") FROM smp WHERE split = '{s}') = 0 AS good, CAST((SELECT count(*) - count(DISTINCT serial_number || '#' || \"window\") FROM smp WHERE split = '{s}') AS DOUBLE) AS evidence" for s in ("train", "calib", "test"))}
    UNION ALL SELECT 'splits share no row', (SELECT count(*) FROM (SELECT 1 FROM smp GROUP BY serial_number, "window" HAVING count(DISTINCT split) > 1)) = 0, CAST((SELECT count(*) FROM (SELECT 1 FROM smp GROUP BY serial_number, "window" HAVING count(DISTINCT split) > 1)) AS DOUBLE)
    UNION ALL SELECT 'splits are apart in time', g > 0, g FROM (SELECT CAST(least(min("window") FILTER (WHERE split = 'calib') - max("window") FILTER (WHERE split = 'train'), min("window") FILTER (WHERE split = 'test') - max("window") FILTER (WHERE split = 'calib')) AS DOUBLE) AS g FROM smp)
    UNION ALL SELECT 'labels are last in ' || s, x > 0.995, x FROM (SELECT s, (SELECT count_if("window" = mw) / CAST(nullif(count(*), 0) AS DOUBLE) FROM (SELECT *, max("window") OVER (PARTITION BY serial_number) AS mw FROM smp WHERE split = s) WHERE label = 1) AS x FROM (VALUES ('train'), ('calib')) v(s))
    UNION ALL SELECT 'hours follow the calendar', m > 0.95 AND m < 1.05, m FROM (SELECT quantile_cont(smart_9_raw_delta / 48.0, 0.5) AS m FROM smp WHERE split = 'train' AND days_span = 2)
    UNION ALL SELECT 'negatives per positive', neg = round_even(pos * 3.0, 0), neg / CAST(nullif(pos, 0) AS DOUBLE) FROM n
    UNION ALL SELECT 'failures are last windows', x > 0.995, x FROM last
    UNION ALL SELECT 'smart_9_raw_last in range', r = 1, r FROM miss
    UNION ALL SELECT 'most missing', x < 0.05, x FROM miss
    UNION ALL SELECT 'counters not negative', neg = 0, CAST(neg AS DOUBLE) FROM miss)
    SELECT "check", CASE WHEN coalesce(good, false) THEN 'PASS' ELSE 'REVIEW' END AS result, round(evidence, 6) AS evidence FROM c"""


@query(_CHECKS)
def audit_checks(spark, sf):
    rows = W.modeling_table(D.daily(spark, sf), D.GRID)
    return A.audit(rows, D.windows(spark, sf), neg_ratio=D.GRID.neg_ratio, ranges={"smart_9_raw_last": (0, 100)}, counters=["smart_5_raw_last", "smart_9_raw_last"], hours=("smart_9_raw_delta", 2))


@query(f"""WITH {D.WINDOWS_SQL}, m AS (SELECT *, max("window") OVER (PARTITION BY serial_number) AS mw FROM win WHERE TRUE)
    SELECT count(*) AS failures, round(count_if("window" = mw) / CAST(nullif(count(*), 0) AS DOUBLE), 6) AS last_share FROM m WHERE failed_in_window = 1""")
def failure_is_last_window(spark, sf):
    return A.failure_is_last_window(D.windows(spark, sf))


@query(f"WITH {D.DAILY_SQL}, m AS (SELECT 'smart_5_raw' AS feature, avg(CAST(smart_5_raw IS NULL AS INT)) AS missing FROM daily UNION ALL SELECT 'smart_197_raw', avg(CAST(smart_197_raw IS NULL AS INT)) FROM daily) SELECT round(missing, 6) AS missing, feature FROM m ORDER BY missing DESC, feature DESC LIMIT 1")
def missing_worst_column(spark, sf):
    return R.worst_missing(D.daily(spark, sf), ["smart_5_raw", "smart_197_raw"])


# --- metrics


def _ap(source: str) -> str:
    return f"(SELECT sum(pos * tp / n) / sum(pos) FROM (SELECT pos, sum(pos) OVER w AS tp, CAST(sum(c) OVER w AS DOUBLE) AS n FROM (SELECT prob, sum(label) AS pos, count(*) AS c FROM {source} GROUP BY prob) WINDOW w AS (ORDER BY prob DESC)))"


@query(f"WITH {D.TIED_SQL} SELECT round({_ap('tied')}, 6) AS average_precision")
def average_precision(spark, sf):
    return M.average_precision(D.tied(spark, sf), "prob", y())


@query(f"WITH {D.TIED_SQL} SELECT round({_auc_sql('prob', 'tied')}, 6) AS roc_auc")
def roc_auc(spark, sf):
    return M.roc_auc(D.tied(spark, sf), "prob", y())


def _sweep_sql(with_: str, source: str, score: str, thresholds: list[float]) -> str:
    return f"""WITH {with_}, t AS (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in thresholds)}]) AS threshold), k AS (SELECT threshold, count_if({score} >= threshold AND label = 1) AS tp, count_if({score} >= threshold AND label = 0) AS fp, count_if({score} < threshold AND label = 1) AS fn FROM t, {source} GROUP BY threshold)
        SELECT threshold, tp, fp, fn, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS precision, round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM k"""


_TENTHS = [i / 10 for i in range(11)]
_MARGINS = [-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5]


@query(_sweep_sql(D.TIED_SQL, "tied", "prob", _TENTHS))
def threshold_sweep(spark, sf):
    return M.threshold_sweep(D.tied(spark, sf), "prob", y(), _TENTHS)


@query(_sweep_sql(f"{D.SCORED_SQL}, m AS (SELECT prob * 4 - 1.5 AS margin, label FROM scored)", "m", "margin", _MARGINS))
def margin_sweep(spark, sf):
    return M.threshold_sweep(D.scored(spark, sf).withColumn("margin", F.col("prob") * 4 - 1.5), "margin", y(), _MARGINS)


@query(f"WITH {D.SCORED_SQL} SELECT round(avg((prob - label) * (prob - label)), 6) AS brier FROM scored")
def brier(spark, sf):
    return M.brier(D.scored(spark, sf), "prob", y())


@query(f"""WITH {D.SCORED_SQL}, s AS (SELECT *, row_number() OVER (ORDER BY prob DESC, id) AS r, count(*) OVER () AS n FROM scored), b AS (SELECT unnest([CAST(1 AS DOUBLE), 2, 5, 10, 41.7]) AS k),
    t AS (SELECT count(*) AS n, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(flag) AS DOUBLE) AS rn, CAST(sum(flag * label) AS DOUBLE) AS rt FROM scored),
    m AS (SELECT b.k, CAST(floor(t.n * b.k / 1000) AS BIGINT) AS budget, t.* FROM b, t), h AS (SELECT m.*, (SELECT CAST(coalesce(sum(label), 0) AS DOUBLE) FROM s WHERE s.r <= m.budget) AS tp FROM m)
    SELECT k AS per_thousand, budget, round(coalesce(tp / nullif(budget, 0), 0), 6) AS precision, round(tp / pos, 6) AS recall, round(rt / rn, 6) AS rule_precision, round(rt / pos * least(budget / rn, 1.0), 6) AS rule_recall, round(pos / n, 6) AS chance_precision, round(budget / CAST(n AS DOUBLE), 6) AS chance_recall FROM h""")
def budget_table(spark, sf):
    return M.budget_table(D.scored(spark, sf), "prob", y(), ["id"], [1, 2, 5, 10, 41.7], F.col("flag"))


@query(f"""WITH {D.SCORED_SQL}, c AS (SELECT prob, sum(label) AS pos, count(*) AS c FROM scored GROUP BY prob), w AS (SELECT prob, sum(pos) OVER o / CAST(sum(c) OVER o AS DOUBLE) AS p, sum(pos) OVER o / CAST((SELECT sum(pos) FROM c) AS DOUBLE) AS r FROM c WINDOW o AS (ORDER BY prob DESC)),
    f AS (SELECT *, round(2 * p * r / (p + r + 1e-12), 12) AS f1 FROM w) SELECT round(prob, 6) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, prob LIMIT 1""")
def max_f1_threshold(spark, sf):
    return M.max_f1(D.scored(spark, sf), "prob", y())


@query(f"WITH {D.SCORED_SQL} SELECT round(avg(prob), 6) AS mean_predicted, round(avg(label), 6) AS mean_actual, round(avg(prob) / avg(label), 6) AS ratio FROM scored")
def calibration_ratio(spark, sf):
    return M.calibration_ratio(D.scored(spark, sf), "prob", y())


@query(f"""WITH {D.SCORED_SQL}, e AS (SELECT list_sort(list_distinct(quantile_cont(prob, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM scored),
    b AS (SELECT CAST(len(list_filter(q[2:len(q) - 1], lambda m: prob > m)) AS INTEGER) AS bin, prob, label FROM scored, e) SELECT bin, count(*) AS n, round(avg(prob), 6) AS mean_predicted, round(avg(label), 6) AS mean_actual FROM b GROUP BY bin""")
def reliability_deciles(spark, sf):
    return M.reliability(D.scored(spark, sf), "prob", y())


@query(f"""WITH {D.LABELLED_SQL}, f AS (SELECT CAST(coalesce(smart_197_raw_delta > 0, false) AS INT) AS flag, label FROM lab), k AS (SELECT CAST(sum(flag) AS BIGINT) AS flagged, CAST(sum(flag * label) AS BIGINT) AS tp, sum(label) AS pos FROM f)
    SELECT flagged, tp, round(coalesce(tp / CAST(nullif(flagged, 0) AS DOUBLE), 0), 6) AS precision, round(coalesce(tp / CAST(nullif(pos, 0) AS DOUBLE), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(flagged + pos, 0), 0), 6) AS f1 FROM k""")
def rule_baseline(spark, sf):
    return M.rule_baseline(D.labelled(spark, sf), "smart_197_raw_delta", y())


@query(f"""WITH {D.SCORED_SQL}, two AS (SELECT 'prob' AS model, id, prob, label FROM scored UNION ALL SELECT 'inverse', id, 1 - prob, label FROM scored), c AS (SELECT model, prob, sum(label) AS pos, count(*) AS c FROM two GROUP BY 1, 2),
    a AS (SELECT model, sum(pos * tp / n) / sum(pos) AS ap FROM (SELECT model, pos, sum(pos) OVER w AS tp, CAST(sum(c) OVER w AS DOUBLE) AS n FROM c WINDOW w AS (PARTITION BY model ORDER BY prob DESC)) GROUP BY model),
    t AS (SELECT model, label, row_number() OVER (PARTITION BY model ORDER BY prob DESC, id) AS r, count(*) OVER (PARTITION BY model) AS n, sum(label) OVER (PARTITION BY model) AS pos FROM two), b AS (SELECT model, sum(label) / CAST(count(*) AS DOUBLE) AS p, sum(label) / CAST(any_value(pos) AS DOUBLE) AS r FROM t WHERE r <= floor(n * 10 / 1000) GROUP BY model)
    SELECT a.model, round(ap, 6) AS average_precision, round(p, 6) AS precision_at, round(r, 6) AS recall_at FROM a JOIN b USING (model)""")
def summary_matrix(spark, sf):
    return M.summary_matrix(D.scored(spark, sf).withColumn("inverse", 1 - F.col("prob")), ["prob", "inverse"], y(), ["id"], 10)


@query(f"WITH {D.SCORED_SQL}, f AS (SELECT id % 4 AS fold, id % 3 AS model, avg(prob) AS score FROM scored GROUP BY 1, 2) SELECT model, round(avg(score), 6) AS score, round(stddev_pop(score), 6) AS score_std FROM f GROUP BY model")
def fold_summary(spark, sf):
    folds = D.scored(spark, sf).groupBy((F.col("id") % 4).alias("fold"), (F.col("id") % 3).alias("model")).agg(F.avg("prob").alias("score"))
    return M.fold_summary(folds, ["model"], ["score"])


# --- features

NUMERIC = [*[f"{s}_{e}" for s in D.SENSORS for e in X.STATS], "capacity_tb", "days_observed"]
_MATRIX = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in NUMERIC if c != "capacity_tb")


@query(f"""WITH {D.ROWS_SQL} SELECT serial_number, "window", label, {_MATRIX}, round_even(CASE WHEN capacity_bytes > 0 THEN capacity_bytes END / 1e12, 0) AS capacity_tb, {D.VENDOR_SQL.format('model')} AS vendor FROM rws""")
def feature_matrix(spark, sf):
    return X.feature_matrix(D.rows(spark, sf), NUMERIC)


@query(f"""WITH {D.ROWS_SQL}, m AS (SELECT quantile_cont(smart_197_raw_delta, 0.5) AS m, quantile_cont(smart_5_raw_last, 0.5) AS k, count_if(smart_197_raw_delta IS NULL) > 0 AS some FROM rws)
    SELECT serial_number, "window", round(coalesce(smart_197_raw_delta, m), 6) AS smart_197_raw_delta, round(coalesce(smart_5_raw_last, k), 6) AS smart_5_raw_last, CAST(smart_197_raw_delta IS NULL AS DOUBLE) AS smart_197_raw_delta_missing FROM rws, m""")
def median_impute_indicator(spark, sf):
    rows = D.rows(spark, sf).select("serial_number", "window", "smart_197_raw_delta", "smart_5_raw_last")
    out = X.Preparation(["smart_197_raw_delta", "smart_5_raw_last"], log=False, scale=False).fit(rows).apply(rows)
    return out if "smart_197_raw_delta_missing" in out.columns else out.withColumn("smart_197_raw_delta_missing", F.lit(0.0))


@query(f'WITH {D.LABELLED_SQL} SELECT serial_number, "window", round(sign(smart_5_raw_delta) * ln(1 + abs(smart_5_raw_delta)), 6) AS v FROM lab')
def signed_log(spark, sf):
    return D.labelled(spark, sf).select("serial_number", "window", C.signed_log(F.col("smart_5_raw_delta")).alias("v"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 5) AS l_quantity FROM lineitem", digits=5)
def standard_scale_pop(spark, sf):
    li = lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity")
    return X.Preparation(["l_quantity"], log=False).fit(li).apply(li)


@query(f'WITH {D.ROWS_SQL}, v AS (SELECT serial_number, "window", {D.VENDOR_SQL.format("model")} AS vendor FROM rws) SELECT serial_number, "window", vendor, ' + ", ".join(f"CAST(vendor = '{v}' AS DOUBLE) AS vendor_{v}" for v in C.VENDORS) + " FROM v")
def onehot_vendor(spark, sf):
    return X.one_hot(D.rows(spark, sf).select("serial_number", "window", C.vendor(F.col("model")).alias("vendor")), "vendor")


@query(f"WITH {D.ROWS_SQL} SELECT label, serial_number, \"window\", round((SELECT count(*) FROM rws) / (2.0 * count(*) OVER (PARTITION BY label)), 6) AS weight FROM rws")
def balanced_weights(spark, sf):
    return X.balanced_weights(D.rows(spark, sf).select("label", "serial_number", "window"))


@query(f"""WITH {D.ROWS_SQL}, w AS (SELECT DISTINCT "window" FROM rws), o AS (SELECT "window", row_number() OVER (ORDER BY "window") - 1 AS i, count(*) OVER () AS n FROM w),
    p AS (SELECT "window", CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE (n % 5) + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS part FROM o), v AS (SELECT part - 1 AS fold, "window", min("window") OVER (PARTITION BY part) AS lo FROM p WHERE part > 0)
    SELECT CAST(fold AS INTEGER) AS fold, 'valid' AS part, "window" FROM v UNION ALL SELECT CAST(f.fold AS INTEGER), 'train', w."window" FROM (SELECT DISTINCT fold, lo FROM v) f JOIN w ON w."window" < f.lo - 1""")
def time_folds(spark, sf):
    return X.fold_table(D.rows(spark, sf))


@query(f"""WITH {D.SCORED_SQL}, g AS (SELECT device, row_number() OVER (ORDER BY md5(concat_ws('#', 42, device))) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT device FROM scored))
    SELECT id, device, CASE WHEN r <= ceil(n / 2.0) THEN 'A' ELSE 'B' END AS half FROM scored JOIN g USING (device)""")
def group_half_split(spark, sf):
    return X.group_halves(D.scored(spark, sf).select("id", "device"), "device")


@query(f"""WITH {D.ROWS_SQL}, g AS (SELECT max("window") AS w FROM rws) SELECT 'train' AS part, count(*) AS n, min("window") AS first, max("window") AS last FROM rws WHERE "window" <= 3
    UNION ALL SELECT 'valid', count(*), min("window"), max("window") FROM rws WHERE "window" >= 5""")
def manual_fold(spark, sf):
    train, valid = X.manual_fold(D.rows(spark, sf).select("window"), 3, 5)
    parts = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.min("window").alias("first"), F.max("window").alias("last")) for name, df in (("train", train), ("valid", valid))]
    return parts[0].unionByName(parts[1])


_BASELINE = [f"{s}_{e}" for s in D.SENSORS for e in X.STATS]


@query(f"""WITH {D.ROWS_SQL} SELECT serial_number, "window", label, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _BASELINE)}, CAST(CASE WHEN capacity_bytes > 0 THEN capacity_bytes END AS DOUBLE) AS capacity_bytes, CAST(days_observed AS DOUBLE) AS days_observed, CAST(days_span AS DOUBLE) AS days_span, {D.VENDOR_SQL.format('model')} AS vendor FROM rws""")
def baseline_matrix(spark, sf):
    return X.baseline_matrix(D.rows(spark, sf), _BASELINE)


_SCORES = "(VALUES ('smart_5_raw_last', 0.2), ('smart_9_raw_delta', 0.1), ('smart_9_normalized_last', 0.4), ('days_span', 0.05)) v(feature, mi)"


@query(f"SELECT CASE WHEN feature LIKE '%\\_normalized\\_%' ESCAPE '\\' THEN 'normalized' WHEN feature LIKE '%\\_raw\\_%' ESCAPE '\\' THEN 'raw' ELSE 'metadata' END AS family, round(sum(CAST(mi AS DOUBLE)), 6) AS total, round(avg(CAST(mi AS DOUBLE)), 6) AS mean, CAST(max(mi) AS DOUBLE) AS greatest FROM {_SCORES} GROUP BY 1")
def family_scores(spark, sf):
    return S.family_scores(spark.sql(f"SELECT feature, CAST(mi AS DOUBLE) AS mi FROM {_SCORES}"))


@query(f"""WITH {D.LABELLED_SQL}, o AS (SELECT count_if(smart_9_raw_last > 0 AND label = 0) AS b, count_if(smart_9_raw_last = 0 AND label = 0) AS d, count_if(smart_9_raw_last > 0 AND label = 1) AS a, count_if(smart_9_raw_last = 0 AND label = 1) AS c FROM lab)
    SELECT 'smart_9_raw_last' AS feature, CASE WHEN coalesce(b / CAST(nullif(b + d, 0) AS DOUBLE), 0) <= 0.95 THEN round(CAST((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)) AS DOUBLE), 6) END AS odds_ratio FROM o""")
def constant_odds(spark, sf):
    return S.without_constant_odds(S.odds_ratios(D.labelled(spark, sf), ["smart_9_raw_last"], y())).select("feature", "odds_ratio")


# --- models: rows only


def _fit(spark, sf, fit, *, log: bool = True, scale: bool = True) -> DataFrame:
    from spinward.operators import models as L

    rows = X.feature_matrix(D.rows(spark, sf), NUMERIC, keep=("serial_number", "window", "label", "split"))
    train, calib = L.prepared(rows.where("split = 'train'"), [rows.where("split = 'calib'")], NUMERIC, log=log, scale=scale)
    return L.predict(fit(train.cache()), calib)


@query()
def lr_fit_score(spark, sf):
    from spinward.operators import models as L

    return _fit(spark, sf, L.logistic())


@query()
def dt_fit_score(spark, sf):
    from spinward.operators import models as L

    return _fit(spark, sf, L.tree(4), log=False, scale=False)


@query()
def rf_fit_score(spark, sf):
    from spinward.operators import models as L

    return _fit(spark, sf, L.forest(10, 4), log=False, scale=False)


@query()
def gbt_fit_score(spark, sf):
    from spinward.operators import models as L

    return _fit(spark, sf, L.boosted(5, 3), log=False, scale=False)


@query()
def svm_nystroem_score(spark, sf):
    from spinward.operators import models as L

    rows = X.feature_matrix(D.rows(spark, sf), NUMERIC, keep=("serial_number", "window", "label", "split"))
    train, calib = L.prepared(rows.where("split = 'train'"), [rows.where("split = 'calib'")], NUMERIC)
    kernel = L.KernelMap(0.05, 40).fit(train, ["serial_number", "window"])
    return L.predict(L.svm()(kernel.apply(train).cache()), kernel.apply(calib))


@query()
def platt_scaling(spark, sf):
    from spinward.operators import models as L

    return L.platt(X.group_halves(D.scored(spark, sf), "device"))


@query()
def expanding_cv(spark, sf):
    from spinward.operators import models as L

    rows = X.feature_matrix(D.rows(spark, sf), NUMERIC).cache()
    folds = L.cross_validate(rows, L.logistic(), NUMERIC)
    return spark.createDataFrame([(f["fold"], f["pr_auc"], f["precision"], f["recall"], f["f1"]) for f in folds], "fold int, pr_auc double, precision double, recall double, f1 double")


@query()
def grid_search_ranked(spark, sf):
    from spinward.operators import models as L

    return L.search(X.feature_matrix(D.rows(spark, sf), NUMERIC).cache(), L.logistic, {"c": [0.01, 1.0]}, NUMERIC, n_folds=2).drop("mean_fit_seconds")


@query()
def random_search_ranked(spark, sf):
    from spinward.operators import models as L

    return L.search(X.feature_matrix(D.rows(spark, sf), NUMERIC).cache(), L.tree, {"max_depth": [2, 3, 4], "min_leaf": [5, 20]}, NUMERIC, n_folds=2, draws=2, log=False, scale=False).drop("mean_fit_seconds")
