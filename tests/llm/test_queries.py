"""The registered queries and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from itemnorm.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, len(queries.QUERIES) + 1)]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "bpe":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[-1] == n[-2] > 100 and n[1] == n[2]
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f g", "en", "s", 13), (None, "a b c d e f g", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.doc_id == 1 for r in out) == 1 and sum(r.doc_id == 2 for r in out) == 1 and 3 <= len(out) <= 4
