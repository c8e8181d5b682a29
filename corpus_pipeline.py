"""A corpus pipeline of five stages over `documents`, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept and what it decides takes effect; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrid.llm import exact_dedup, mixing, ngram_join, quality, sentencepiece_codec
from cinegrid.llm.common import Scratch, table

#: Near-duplicates: five-word shingles at a Jaccard similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, trained on the labelled rows among them, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=quality.THRESHOLD)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return ngram_join.keep_one_of_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, their number and the digest of what they decode to."""
    coded = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), "text", "ids", decoded="text")
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact),
    ("n-gram Jaccard join", drop_near),
    ("mixing sources", mix_sources),
    ("sentencepiece encoding", tokenize),
]

#: The classifier, the similarity join and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
