"""Every query runs; those with SQL equal DuckDB's answer."""

import datetime
import decimal
import math

import duckdb
import pytest

from spinward.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"expanding_cv", "grid_search_ranked", "random_search_ranked", "svm_nystroem_score"}


@pytest.fixture(scope="module")
def db(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return out


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    rel = db.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    want = ordered([tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect() is not None


def test_no_python_in_queries_with_sql(spark, sf_dir):
    for name in ("modeling_table", "audit_checks", "spearman", "budget_table", "median_impute_indicator"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_scans_are_pruned(spark, sf_dir):
    plan = QUERIES["pruned_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_extendedprice" not in plan
