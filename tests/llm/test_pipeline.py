"""Stages and queries over the small tables."""

import duckdb
import pytest

import corpus_pipeline
from tidelog.llm import queries
from tidelog.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SF), name)
        assert 0 < after.count() <= docs.count()
        assert after.columns == first.columns or name == "tokens"
        docs = after
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    expected = sorted(want.fetchall(), key=str)
    found = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=str) == expected and expected
