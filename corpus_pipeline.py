"""A corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's docs.

Defined results, for every stage: an empty table gives an empty one with the same columns;
columns that have the name of an operator's own come through as they are; repeated rows
(equal texts) are one from the second stage on. What a stage does with null ids and texts is
said there. The tables of a run lie in one folder below spark.checkpoint.dir, to be cleared with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import langid, mixing, neardup, packing, pii
from termloom.llm.common import materialise, shared_folder
from termloom.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay: those with a null text, without a letter, or unlike every learned language go; ids don't matter."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one of the smallest id (of rows that share it, any one), or one without an id where all ids are null. Null and empty texts are one class."""
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates in `text`, and `n_chars` is counted anew; every row stays, null texts stay null."""
    return pii.replace(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per whole copy that the mix takes, and one cut document per source; rows that tie at the cut share it. A null source is one of its own; texts without a word are left out."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids; every row is packed for itself, a null text as the one id at its end."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]

#: Trained profiles, sampled signatures and tokenizers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written and read again."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), folder, f"{i}-{name}")
    return docs
