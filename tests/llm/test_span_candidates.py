"""The span model learns from every document."""
from pyspark.sql import functions as F

from rebuyflow.llm import personal_data


def test_every_document_is_learned_from(spark, monkeypatch):
    docs = spark.range(3300).select(F.col("id").alias("doc_id"), F.concat(F.lit("call +1 555 010 "), F.col("id") % 7 + 1000, F.lit(" or a@b.cc")).alias("text"))
    kept = []

    def stage(df, name):
        kept.append(df.cache())
        return kept[-1]

    monkeypatch.setattr(personal_data, "stage", stage)
    personal_data.fit_spans(docs, rounds=1, depth=1)
    expected = docs.select(F.explode(personal_data.candidates(F.col("text")))).count()
    assert kept[0].agg(F.sum("n")).first()[0] == expected and kept[0].count() < 200
