"""A corpus made ready for training: five stages, each one operator, written and read again in between.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
``documents``; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import bpe, jaccard, linededup, mixing, toxicity
from pageloom.llm.storage import Scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = toxicity.learn(docs, labels, Scratch(spark, "pipeline-toxicity"))
    return toxicity.drop_toxic(docs, grammar)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; n_chars follows the text."""
    out = linededup.dedup_lines(docs, Scratch(spark, "pipeline-lines"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    found = jaccard.jaccard_join(docs, Scratch(spark, "pipeline-jaccard"), size=5, percent=80)
    surplus = found.where("component_id <> doc_id").select("doc_id")
    return docs.join(surplus, "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mixed_documents(docs, Scratch(spark, "pipeline-mixing"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with the hash of the bytes they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, vocabulary, keep=("doc_id", "lang", "source"), ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources", mixed),
    ("byte-level BPE", token_ids),
]

# The learned grammar and the knapsack cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for place, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{place}")
        if place:
            scratch.drop(f"stage-{place - 1}")
    return docs
