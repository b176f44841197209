"""The pipeline's stages: what each does to odd rows, and the whole against the operators applied by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import decontamination, oracles, queries, setjoin

SF = "/root/testdata/sf0.001"


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns and docs.count() == docs.select("doc_id").distinct().count() <= n[-1], name
        n.append(docs.count())
        if name == "minhash_near_dedup":
            again = setjoin.near_duplicates(docs, 5, 80)
            assert again.filter(~F.col("kept")).count() == 0
    assert n[0] > n[1] > n[2] > n[3] >= n[4]
    assert decontamination.find(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()} and all(r.n_tokens == len(r.ids) for r in out)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, odd, empty, k):
    stage = corpus_pipeline.STAGES[k][1]
    rows = stage(spark, odd, SF).collect()
    assert len(rows) == odd.count() - (k == 2) * 2 or k in (0, 1, 3)
    assert stage(spark, empty, SF).count() == 0
    if k < 4:
        assert stage(spark, odd, SF).columns == odd.columns


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(oracles.ORACLES[name]).df()
    key = sorted(ours.columns)
    rows = lambda f: sorted(map(str, f[key].astype(object).itertuples(index=False, name=None)))
    assert rows(ours) == rows(theirs)
