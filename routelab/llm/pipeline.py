"""Raw documents to training ids in five stages, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
``documents``; each works on all rows that its predecessor kept.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.llm.common import scratch, table
from routelab.llm.exact_dedup import drop_exact_duplicates
from routelab.llm.jaccard import drop_near_duplicates
from routelab.llm.mixing import mixed_documents
from routelab.llm.quality import keep_good
from routelab.llm.segment import sample_encodings
from routelab.llm.vocabularies import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; all columns. Null and empty texts are scored on zero statistics; repeated rows go or stay together; no documents, no rows."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts; all columns. Null is the empty text; of repeated rows one stays; the smallest id wins, a null id last."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; all columns. Texts without words are no duplicates; the smallest id wins; very long texts are compared whole."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a cut document's ``n_chars`` follows its text. Texts without words weigh nothing and are not taken; a null source is a source; no
    documents, no rows."""
    mixed = mixed_documents(docs)
    if "n_chars" not in docs.columns:
        return mixed
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document: doc_id, draw, ids, log_prob, perturbed, inclusion. Null and empty texts have one empty draw; repeated rows draw alike."""
    return sample_encodings(docs, vocabulary_path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixture), ("sentencepiece", tokens)]

# The classifier, the banding and the draws have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = scratch(spark, "pipeline")
    for name, stage in STAGES:
        path = os.path.join(base, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
