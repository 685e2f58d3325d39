"""A corpus cleaned in stages: toxic documents go, one document of each near-duplicate group stays, personal data is
redacted, sources are mixed to target weights, and the rest is encoded.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as the next one's
documents. All but the last return the columns of `documents`.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebuyflow.llm.catalog import PIECES, TOXIC
from rebuyflow.llm.jaccard_join import jaccard_roots, text_digest
from rebuyflow.llm.personal_data import find_spans, fit_spans, redact
from rebuyflow.llm.piece_codec import encode_pieces, read_model
from rebuyflow.llm.tables import read
from rebuyflow.llm.temperature_mix import mix_sources
from rebuyflow.llm.toxicity import fit_toxicity, score_toxicity
from rebuyflow.plans.stages import stage


def _back(docs: DataFrame, changed: DataFrame) -> DataFrame:
    return changed.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold."""
    scored = score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")), score_col="_score", sentences_col="_places")
    return _back(docs, scored.filter(F.col("_score") < TOXIC))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (null ids last, then by a digest of the text); a repeated row stays once."""
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "t")
    first = jaccard_roots(docs).groupBy("root").agg(F.min(place).alias("first")).select(F.col("first.id").alias("_first"), F.col("first.t").alias("_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("_first")) & (text_digest(F.col("text")) == F.col("_digest"))
    return _back(docs, docs.join(first, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by marks; n_chars follows the text."""
    found = find_spans(docs, fit_spans(docs))
    text = F.when(F.col("text").isNotNull(), redact(F.col("text"), F.col("spans")))
    return _back(docs, found.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents of flat sources repeat, those of the hot source are drawn within its budget."""
    return _back(docs, mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its piece ids."""
    encoded = encode_pieces(docs.select("doc_id", "source", "text"), read_model(public_tokenizers.path(PIECES)))
    return encoded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data), ("mix", mix), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
