"""Rows at the edge: huge and tiny vectors, null ids in large groups, awkward column names."""
import math
from collections import Counter

import numpy as np

from rebuyflow.llm.block_search import nearest
from rebuyflow.llm.hilbert_shards import hilbert_shards
from rebuyflow.llm.personal_data import SpanModel, find_spans
from rebuyflow.llm.temperature_mix import mix_sources
from pyspark.sql import functions as F


def plain_distance(a, b):
    return math.dist([x / 2**600 for x in a], [x / 2**600 for x in b]) * 2**600 if max(map(abs, [*a, *b])) > 1e150 else math.dist(a, b)


def test_huge_and_tiny_vectors_are_found(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=4) * s).tolist()) for i, s in enumerate([1e200] * 30 + [1.0] * 30 + [1e-200] * 10)] + [(100, [1e200, 0.0, 0.0, 0.0]), (101, [1.7e308, 0.0, 0.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 5).collect()
    for query, own in rows:
        if query % 10 == 0:
            expected = sorted((plain_distance(own, v), i) for i, v in rows if i != query)[:5]
            found = sorted((x["rank"], x["vec_id"], x["score"]) for x in got if x["query_id"] == query)
            assert [f[1] for f in found] == [e[1] for e in expected]
            assert np.allclose([f[2] for f in found], [e[0] for e in expected], rtol=1e-12)


def test_null_ids_of_a_large_group_are_spread(spark):
    rows = [(None, "same text " * 5, "en", "a") for _ in range(2000)] + [(i, f"other {i} " * 5, "en", "a") for i in range(2000)]
    placed = hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 16)
    sizes = {r["shard"]: (r["b"], r["n"], r["top"]) for r in placed.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    assert len(sizes) == 16 and sum(n for _, n, _ in sizes.values()) == 4000
    assert max(b for b, *_ in sizes.values()) < 1.05 * min(b for b, *_ in sizes.values())
    assert all(top == n - 1 for _, n, top in sizes.values())


def test_null_and_repeated_ids_are_spread_over_blocks(spark):
    rows = [(None if i % 2 else 7, f"text number {i}", "a", "x", {"k": 1}) for i in range(600)]
    mixed = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` string, m map<string,int>"))
    assert mixed.select("mix_block").distinct().count() > 300
    assert "a.b" in mixed.columns
    assert Counter(r["text"] for r in mixed.collect()) == Counter(r[1] for r in rows)


def test_awkward_names_and_repeated_names(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org now", 1, 2, 3)], ["doc_id", "text", "_found", "a.b", "found"])
    got = find_spans(docs, SpanModel((), ()))
    assert got.columns == ["doc_id", "text", "_found", "a.b", "found", "base_spans", "spans"]
    assert [(s["start"], s["end"]) for s in got.first()["base_spans"]] == [(5, 12)]
