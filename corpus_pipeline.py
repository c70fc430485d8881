"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, mixing, simhash, toxicity
from quarry.llm.common import table, through_parquet
from quarry.llm.queries import vocabulary_file


#: Columns that order the mixed rows.
PLACE = ("mixed_slot", "mixed_offset")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, with all their columns whatever their names; empty and null texts and null keys stay, repeated rows are judged each."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near-duplicates, with all its columns whatever their names. Texts without a
    word are copies of each other; rows without a doc_id stay where their group has no other; of repeated rows one stays."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mixed order, with the columns of ``PLACE`` that hold it, as a reread may come in another. They replace
    columns of these names. A null source is a source of its own; repeated rows and null keys and texts are rows like others."""
    return mixing.in_order(docs, place=PLACE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and place in the mix with ids, n_tokens and hashes of ids and of the decoded text. Null and empty texts have
    no tokens; other columns are left out."""
    return bpe.encode_decode(docs, vocabulary_file(), ["doc_id", "source", *PLACE], full=True)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("mix_sources", mix_sources), ("bpe", encode)]

#: Fitted scores and a tokenizer's merges have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = through_parquet(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
