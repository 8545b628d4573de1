"""Corpus pipeline: from raw documents to encoded training text.

Each stage takes (spark, docs, sf_dir) and returns the documents for the next one; stages are written as Parquet
under the shared checkpoint folder and read again. All stages but the last keep the columns of ``documents``.

1. toxicity: documents predicted toxic go (``llm.toxicity``; labels come from the ``labels`` table);
2. exact dedup: of equal texts one stays (``llm.exact_dedup``);
3. MinHash near-dedup: of each class of near copies one stays (``llm.bagminhash``);
4. mixing: each document is used as often as its rate towards the target weights says (``llm.mixing``);
5. SentencePiece: piece ids of each document (``llm.sentencepiece_viterbi``).

A classifier, compression lengths and hashes over whole texts are not expressible in SQL, so there is no ORACLE_SQL;
``tests/llm/test_pipeline.py`` holds the stages against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm.bagminhash import drop_near_duplicates
from sitelens.llm.exact_dedup import drop_exact_duplicates
from sitelens.llm.mixing import mix
from sitelens.llm.sentencepiece_viterbi import encode
from sitelens.llm.toxicity import drop_toxic
from sitelens.llm.toxicity import train as train_toxicity
from sitelens.session import ensure_checkpoint_dir, scratch_dir, ship_package

ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return drop_toxic(docs, train_toxicity(docs, _labels(spark, sf_dir)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return drop_exact_duplicates(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return mix(docs, _labels(spark, sf_dir))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return encode(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("minhash_dedup", minhash_dedup), ("mixing", mixing),
          ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _ready(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
