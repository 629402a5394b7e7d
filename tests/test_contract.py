"""Every registered query against its SQL at the smallest scale, and the shape of the plans."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

NAMES = sorted(n for n in contract.queries() if n != "pipeline" and not re.match(r"op\d+_", n))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return f"{type(value).__name__}:{value}"

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = df.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(cursor.fetchall(), columns)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["date_week", "emotion", "z_score", "national_value", "expected_value", "deviation_pct", "severity"]
    assert df.count() > 0


def test_hot_selections_are_pruned_before_the_shuffle(spark):
    for name in ("merge_best_status", "spread_smoke", "user_scan", "province_top_emotions"):
        plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan, name


def test_texts_are_not_shuffled_for_chosen_ids(spark):
    for name in ("stratified_pick_week", "top_posts_per_region_emotion"):
        plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan, name


def test_scans_read_only_needed_columns(spark):
    plan = contract.queries()["largest_provinces"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "c_acctbal" not in plan
