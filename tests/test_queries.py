"""Every query against its SQL in DuckDB on the smallest test tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def shares(df):
    """Scores: positive, and of sum 1 per task."""
    totals = {}
    for r in df.collect():
        assert r.s > 0
        totals[r["ticker"] if "ticker" in df.columns else None] = totals.get(r["ticker"] if "ticker" in df.columns else None, 0.0) + r.s
    return all(abs(t - 1) < 1e-9 for t in totals.values())


def rows(df):
    return sorted(map(str, df.collect()))


def readable_payloads(spark):
    return entry.queries()["ingest_counters"](spark, str(FOLDER)).agg({"n_readable": "sum"}).first()[0]


#: What must hold of a query that no SQL checks.
FACTS = {
    "p3_branches": lambda spark, df: df.where("n_leaves >= 0 AND branch_no >= 0").count() == df.count() > 0,
    "p4_flags": lambda spark, df: rows(df.where("flag IN ('spike', 'stuck', 'impossible')").select("ticker", "sidx").distinct()) == rows(QUERIES["p4_found"](spark, str(FOLDER))),
    "p5_found": lambda spark, df: df.where("change_kind NOT IN ('added', 'removed', 'renamed', 'retyped', 'resized')").isEmpty() and not df.isEmpty(),
    "p5_alternatives": lambda spark, df: df.where("NOT (share > 0 AND share <= 1 AND n > 0)").isEmpty() and not df.isEmpty(),
    "p5_consistent": lambda spark, df: df.count() == readable_payloads(spark),
    "breakout_stream": lambda spark, df: rows(df) == rows(QUERIES["breakout_replay"](spark, str(FOLDER))),
    "breakout_replay": lambda spark, df: df.where("resolved_sidx <= trigger_sidx OR label NOT IN (0, 1) OR range_high < range_low").isEmpty(),
    "univariate_fits": lambda spark, df: df.where("n < 20 OR isnan(coef) OR isnan(intercept)").isEmpty() and not df.isEmpty(),
    "walk_forward_oos": lambda spark, df: df.where("score <= 0 OR score >= 1 OR pos < 200").isEmpty() and not df.isEmpty(),
    "meta_importance": lambda spark, df: df.where("importance < 0 OR abs(signed_mean) > 1e6").isEmpty(),
    "circular_shift_evidence": lambda spark, df: df.where("p <= 0 OR p > 1").isEmpty() and not df.isEmpty(),
    "linked_cohorts": lambda spark, df: df.where("cluster > member").isEmpty() and df.count() == df.select("member").distinct().count(),
    "binary_training_rows": lambda spark, df: df.where("y NOT IN (0, 1) OR size(x) != 2").isEmpty() and df.count() == df.select("ticker", "hk", "pos").distinct().count(),
    "bucket_training_rows": lambda spark, df: df.where("guess NOT BETWEEN 0 AND 4 OR truth NOT BETWEEN 0 AND 4 OR size(p) != 5 OR abs(aggregate(p, 0D, (s, x) -> s + x) - 1) > 1e-6").isEmpty(),
    "hit_training_rows": lambda spark, df: df.where("hit NOT IN (0, 1, 2)").isEmpty(),
    "same_vector_clusters": lambda spark, df: df.where("representative > member").isEmpty(),
    "submission_vectors": lambda spark, df: df.where("n <= 0 OR width <= 0").isEmpty() and not df.isEmpty(),
}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES.keys() - SQL.keys() if n[:2] not in ("p1", "p6", "p7", "p8")))
def test_facts_of_queries_without_sql(spark, name):
    df = QUERIES[name](spark, str(FOLDER))
    assert FACTS[name](spark, df) if name in FACTS else shares(df)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_found_queries_have_the_stated_columns(spark):
    stated = {
        "p2_found": "ticker string, sidx bigint",
        "p3_found": "src string, ts bigint, root string, branch string, leaf string",
        "p4_found": "ticker string, sidx bigint",
        "p5_found": "feed string, file_no bigint, change_kind string, field_before string, field_after string",
        "p1_found": "ticker string, sidx_a bigint, hotkey_a string, sidx_b bigint, hotkey_b string",
        "p8_found": "doc_id bigint",
    }
    for name, columns in stated.items():
        if name in QUERIES:
            df = QUERIES[name](spark, str(FOLDER))
            assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns
            assert df.count() == df.distinct().count()
