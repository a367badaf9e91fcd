"""Documents to packed training sequences, stage by stage.

Each stage takes what the one before it kept, as Parquet, and hands on the columns of ``documents``; the last returns the packed pieces.
An empty table runs through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import mixing, packing, rules, setsketch
from limnos.llm.words import table
from limnos.session import settle

# SQL cannot express the sketches, the seeded order of documents or the tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the cascade leave."""
    return rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return setsketch.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the blocks of 64 words that their source is granted take them, up to three times."""
    return mixing.repeat_documents(docs, block=64)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place."""
    pieces = packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(settle(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pack-pieces"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
