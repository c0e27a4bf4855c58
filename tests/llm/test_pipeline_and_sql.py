import os

import duckdb
import pandas as pd
import pytest
from helpers import components

import corpus_pipeline
from tangentia.llm import langid, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared tables")


def _rows(df, columns):
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and _rows(got, columns) == _rows(want, columns)


def test_there_is_a_query_for_every_operator():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 11))


def _by_sql(tmp_path, docs, name):
    """The registered SQL of a query over ``docs`` as ``documents``."""
    path = f"{tmp_path}/{name}.parquet"
    docs.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    return con.execute(registry.oracle_sql()[name]).fetchdf()


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    """Every stage against what decides it: predictions, SQL over its own input, or all pairs of documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF).cache()
        assert kept.columns == docs.columns, name
        before, after = {r["doc_id"] for r in docs.select("doc_id").collect()}, {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert after <= before
        if name == "language":
            assert after == {r["doc_id"] for r in langid.identify(docs).where("not rejected").collect()}
        elif name == "quality":
            want = _by_sql(tmp_path, docs, "op2_divergence")
            assert after == set(want[want.kept].doc_id) < before
        elif name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert after == set(components(rows, 80).values()) < before
        elif name == "decontaminate":
            want = _by_sql(tmp_path, docs, "op4_decontaminate")
            assert after == set(want[~want.contaminated].doc_id) < before
        docs = kept
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.columns == [*docs.columns, "taken"]
    want = _by_sql(tmp_path, docs, "op7_mix")
    want = {r.doc_id: r.taken for r in want.itertuples() if r.taken > 0}
    assert {r["doc_id"]: r["taken"] for r in mixed.collect()} == want
    assert {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_pipeline_of_nothing(spark, tmp_path):
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_of_the_tables_takes_pairs_from_080_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == set(components(rows, 80).values()) < set(components(rows).values())
