"""From raw documents to packed training sequences: every stage is written as Parquet and reread by the next.

Defined cases, for every stage: texts are taken whole, however long; extra columns pass through whatever their names (packing
returns its own); an empty table stays empty. A document with null or empty text, or one without letters, has no language and goes in
the first stage; a null language or source is a value of its own; a null doc_id is a document like any other, except that it links
with none in the dedup. Rows that repeat a doc_id and text are judged alike, are one document to the dedup, share a draw, and are
packed each. Ties: the smallest doc_id of a group stays; languages go by alphabet. Nothing is drawn by place or partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyspan.llm import language, minhash, mixing, packing, quality
from keyspan.llm.common import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough, under the language found."""
    return language.accept(docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 80 %)."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn towards the target shares of sources, languages and topics."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    return packing.pack_documents(spark, docs)


STAGES = [("language_id", language_id), ("quality_filter", quality_filter), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Trained models, sketches and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents of sf_dir."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
