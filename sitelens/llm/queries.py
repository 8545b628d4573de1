"""Registered queries of the training-data operators: ``(spark, sf_dir) -> DataFrame`` each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.bagminhash import near_duplicates
from sitelens.llm.conversation_repair import damage, repair_report
from sitelens.llm.exact_dedup import exact_dedup
from sitelens.llm.feast_whitening import whitened_components
from sitelens.llm.learned_partitions import nearest
from sitelens.llm.mixing import mixing_rates
from sitelens.llm.norm_sorted_topk import top_products
from sitelens.llm.pii_boost import find_pii
from sitelens.llm.pii_boost import train as train_pii
from sitelens.llm.relative_lz import relative_lz_dedup
from sitelens.llm.sentencepiece_viterbi import encode_checked
from sitelens.llm.suffix_radix import repeated_spans
from sitelens.llm.toxicity import held_out, toxicity_scores, train
from sitelens.llm.url_filter import CONTRACT_RULES, filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = find_pii(docs, train_pii(docs))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), CONTRACT_RULES, id_col="page_id")


def op3_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relative_lz_dedup(table(spark, sf_dir, "documents"), length=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_checked(table(spark, sf_dir, "documents"))


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"), components=16)


def op12_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, damage(conversations))


QUERIES = {f.__name__: f for f in (
    op1_pii_boost, op2_exact_dedup, op3_relative_lz, op4_toxicity, op5_mixing, op6_url_filter, op7_bagminhash,
    op8_sentencepiece, op9_learned_partitions, op10_suffix_radix,
    op11_feast_whitening, op12_norm_sorted_topk, op13_conversation_repair)}
