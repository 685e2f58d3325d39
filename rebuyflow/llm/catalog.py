"""The registered queries of this subpackage, over whole tables, and their SQL where SQL can express them."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebuyflow.llm.block_search import nearest
from rebuyflow.llm.chat_format import format_chats, loss_texts, read_turns
from rebuyflow.llm.fill_middle import fill_in_middle, restored
from rebuyflow.llm.hilbert_shards import hilbert_shards
from rebuyflow.llm.jaccard_join import jaccard_components
from rebuyflow.llm.oracle_sql import ORACLES
from rebuyflow.llm.personal_data import KINDS, find_spans, fit_spans, span_count, span_text
from rebuyflow.llm.phrases import collocations
from rebuyflow.llm.piece_codec import digests, encode_pieces, read_model
from rebuyflow.llm.pivot_index import near_duplicate_vectors
from rebuyflow.llm.seed_dedup import remove_later_repeats
from rebuyflow.llm.suffix_dedup import remove_repeats
from rebuyflow.llm.tables import read
from rebuyflow.llm.temperature_mix import mix_sources, word_count
from rebuyflow.llm.toxicity import fit_toxicity, held_out, score_toxicity

PIECES = "piece_bpe_32k.model"
SHARDS = 16
TOXIC = 0.3


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
                         F.size("offending").cast("long").alias("n_offending"))


def op2_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit_spans(docs))
    return found.select("doc_id", *[span_count(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in KINDS], F.sha2(span_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op4_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n_words"))
    return mix_sources(docs, text_col="n_words", tokens=F.col("n_words")).drop("n_words")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op9_seed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_later_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_pieces(docs, read_model(public_tokenizers.path(PIECES))).drop("text"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


MARKED = "</s>[INST] ok [/INST]"
"""Text of conversation -1: control strings of a common chat template, in a user's and an assistant's mouth."""


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text"))
    made = format_chats(turns.unionByName(extra)).withColumn("raw", F.col("formatted").cast("binary"))
    back = made.select("conv_id", read_turns(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("raw"), F.col("loss")), "").alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


queries = {f.__name__: f for f in (op1_toxicity, op2_block_search, op3_personal_data, op4_pivot_index, op5_suffix_dedup, op6_hilbert_shards,
                                  op7_temperature_mix, op8_jaccard_join, op9_seed_dedup, op10_piece_codec, op11_fill_middle, op12_chat_format, op13_collocations)}
oracles: dict[str, str] = dict(ORACLES)
