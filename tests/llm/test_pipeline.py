import os

import duckdb
import pytest
from helpers import ROWS, docs
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from feltgrid.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in queries.queries()}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    df = contract.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_stages_keep_columns_and_clean_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "secrets", "packing"]
    base = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, base, SF)
        assert out.columns == base.columns and out.dtypes == base.dtypes
        if name != "near_copies":
            assert out.count() > 0.7 * base.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, base, SF)
    assert packed.select("doc_id").distinct().count() == base.count()


def test_stages_take_awkward_rows(spark):
    df = docs(spark).withColumn("n_chars", F.col("n_chars").cast("long"))
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, df, SF).count() > 0
        assert step(spark, docs(spark, []), SF).count() == 0
    assert len(ROWS) == df.count()
