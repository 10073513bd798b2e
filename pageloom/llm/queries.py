"""The registered queries of this package: thin views of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import (
    bpe,
    collocations,
    conversations,
    embeddings,
    fertility,
    htmltext,
    jaccard,
    kneser,
    linededup,
    mixing,
    packing,
    toxicity,
    warc,
)
from pageloom.llm.storage import Scratch


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return jaccard.jaccard_join(docs, Scratch(spark, "jaccard"), size=3, percent=90)


def toxic_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    grammar = toxicity.learn(docs, table(spark, sf, "labels"), Scratch(spark, "toxicity"))
    scored = toxicity.score_documents(docs, grammar)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf, "documents"), Scratch(spark, "lines"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return out.select("doc_id", "n_lines", "n_dropped", kept)


def source_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf, "documents"), Scratch(spark, "mixing"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("long"), "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "kneser")
    return kneser.classify(table(spark, sf, "documents"), table(spark, sf, "labels"), scratch)


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return htmltext.extract(table(spark, sf, "pages"), Scratch(spark, "html"))


def token_fertility(spark: SparkSession, sf: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return fertility.judge(table(spark, sf, "documents"), Scratch(spark, "fertility"), model)


def warc_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """A revisit carries no payload; its length is what the metadata record says and its digest the header's."""
    found = warc.captures(table(spark, sf, "pages"), Scratch(spark, "warc"), payloads=False)
    revisit = F.col("capture.kind") == "revisit"
    size = F.when(revisit, F.col("metadata.fields")["payload-bytes"].cast("long")).otherwise(F.col("capture.n_bytes"))
    sha = F.when(revisit, F.col("capture.payload_digest")).otherwise(F.col("capture.computed_digest"))
    return found.select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        size.alias("payload_bytes"),
        sha.alias("payload_digest"),
        F.col("capture.kind").alias("record_type"),
        F.substring_index("capture.refers_to", "page:", -1).cast("long").alias("refers_to"),
    )


def embedding_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf, "embeddings"), Scratch(spark, "embeddings"))


def conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = conversations.damage(table(spark, sf, "conversations"))
    return conversations.repair(rows, Scratch(spark, "conversations"))


def phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"), Scratch(spark, "collocations"))


def lexical_packing(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(table(spark, sf, "documents"), Scratch(spark, "packing"), vocabulary)
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard,
    "op2_kneser_ney": kneser_ney,
    "op3_html_text": html_text,
    "op4_toxicity": toxic_scores,
    "op5_line_dedup": line_dedup,
    "op6_token_fertility": token_fertility,
    "op7_source_mix": source_mix,
    "op8_warc_transactions": warc_transactions,
    "op9_embedding_duplicates": embedding_duplicates,
    "op10_byte_bpe": byte_bpe,
    "op11_conversation_repair": conversation_repair,
    "op12_phrase_collocations": phrase_collocations,
    "op13_lexical_packing": lexical_packing,
}
