"""The stages one after the other, and the registered queries, on the smallest tables."""
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rebuyflow.llm.catalog import oracles, queries
from rebuyflow.llm.jaccard_join import jaccard_components
from tools.compare import multiset, oracle_connection

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = given = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, step(spark, docs, SF)
        assert docs.columns == given.columns
        if name == "near_duplicates":
            firsts = {r["component_id"] for r in jaccard_components(before).collect()}
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(firsts)
        if name == "personal_data":
            assert docs.count() == before.count()
            assert not docs.filter(F.regexp_like("text", F.lit("[a-z0-9]@mail[0-9]*[.]example"))).head(1)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "ids"} <= set(out.columns)


def test_all_are_registered():
    registered = __spark_entry__.queries()
    assert {*queries, "pipeline"} <= set(registered)
    assert [n.split("_")[0] for n in queries] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", sorted(oracles))
def test_oracle(spark, name):
    got = queries[name](spark, SF)
    cur = oracle_connection(SF).execute(oracles[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert multiset(got.columns, [tuple(r) for r in got.collect()]) == multiset(columns, cur.fetchall())
