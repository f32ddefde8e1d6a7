"""A training-corpus pipeline of five stages; each works on all documents that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
Rows are told apart by id and text, so null or repeated ids do no harm; rows equal in both share their fate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common
from sparkloom.llm.decontaminate import find_contamination
from sparkloom.llm.exact_dedup import drop_copies
from sparkloom.llm.jaccard import jaccard_components
from sparkloom.llm.langid import identify, train
from sparkloom.llm.packing import pack_documents
from sparkloom.llm.queries import table, vocabulary

KEY = "__pipeline_key"
#: A document must have at least this share of its letters in one language.
LEAST_SHARE = 0.5


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose key is in gone."""
    gone = common.cut(gone.select(F.col(f"{KEY}.id").alias("__gone_id"), F.col(f"{KEY}.text").alias("__gone_text")).distinct())
    match = docs["doc_id"].eqNullSafe(gone["__gone_id"]) & (F.xxhash64(docs["text"]) == gone["__gone_text"])
    return docs.join(gone, match, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language is known and holds at least LEAST_SHARE of the letters."""
    model = train(docs.filter(~common.held_out("doc_id", 4, 2)))
    found = identify(keyed(docs), model, id_col=KEY)
    return without(docs, found.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    found = jaccard_components(keyed(docs), 80, 100, 5, id_col=KEY)
    return without(docs, found.filter(~F.col(KEY).eqNullSafe(F.col("component_id"))))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; one item is enough to drop a document, unlike in op9's report."""
    found = find_contamination(keyed(docs), table(spark, sf_dir, "benchmark"), least_items=1, id_col=KEY)
    return without(docs, found.filter("contaminated"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left and their places in sequences."""
    return pack_documents(docs, vocabulary(), 2048)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_jaccard", ngram_jaccard), ("decontaminate", decontaminate), ("best_fit_packing", best_fit_packing)]

#: Viterbi labels, hash-ordered training and packing have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
