"""Corpus pipeline: from raw documents to token ids of a weighted mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Defined cases, for every stage: an empty table gives no rows; texts are read whole, however long;
columns besides doc_id, text, lang and source, whatever their names, are carried along and decide
nothing. Null, empty and tied rows are stated by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marram.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from marram.llm.common import discard, last_stored, scratch, stored
from marram.llm.vocabulary import default_vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; texts that are null or without letters and hopeless scores go.

    Repeated rows go or stay together; a null id or lang is no ground to go.
    """
    return language_id.with_language(docs)


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id; null ids come last, a null text equals an empty one.

    Of rows that repeat id and text one stays.
    """
    return exact_dedup.without_copies(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Rows without an id or without words are in no group and stay; rows that repeat an id are judged
    each by its own text.
    """
    return near_dedup.without_near_copies(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; a document comes back once for each time that it is used.

    Documents without words do not come back; a null source is a source of its own, the last one;
    repeated rows are documents of their own.
    """
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit), round_trip (decoding gives the text back).

    One row for each row of docs; a null text is empty and has no ids.
    """
    return bpe.encode(docs, default_vocabulary(), carry=["source"]).select("doc_id", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("language ID", known_language),
    ("exact dedup", one_of_each_text),
    ("MinHash near-dedup", one_of_each_group),
    ("mixing sources to target weights", target_mix),
    ("BPE encoding and decoding", token_ids),
]

#: The language model, the mix's draws and BPE cannot be written as SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage stored is removed once the next one's docs are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir))
            keep.append(last_stored())
        discard(spark, before)
        before = keep
    return STAGES[-1][1](spark, docs, sf_dir)
