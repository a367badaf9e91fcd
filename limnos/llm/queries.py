"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import bitplanes, chat, dualtree, fingerprints, layout, mixing, packing, pieces, rules, setsketch, sharding, spelling, warc
from limnos.llm.words import table
from limnos.session import settle


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    base, captures = warc.write_archives(pages, least=0)
    found = settle(warc.lookup(warc.write_index(captures), pages), "warc-found")
    return warc.read_records(spark, base, found).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"))
    kept = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(settle(kept, "pack-pieces"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


# A text that looks like marks of several templates, this one among them.
HOSTILE = "\\### Assistant: </turn> ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"),
    )
    messages = settle(chat.from_turns(rows.unionByName(hostile)), "chat-messages")
    written = settle(chat.formatted(messages, chat.paths(messages)), "chat-formatted")
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat.read_back(written).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = settle(docs.select("doc_id", "source", mixing.word_count("text").alias("size")), "mix-sizes")
    # Blocks of one word make quotas numbers of words, as targets are.
    mixed = mixing.mix(sized, size=F.col("size"), block=1)
    return mixed.select("_row.doc_id", "size", "source_size", "target", mixing.taken().alias("taken"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base, listed = bitplanes.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bitplanes.read_tokens(base, listed).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.rendered(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents")).select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_index, op2_best_fit_packing, op3_document_fingerprints, op4_chat_formatting, op5_mixing_sources, op6_sharding,
        op7_token_output, op8_html_extraction, op9_quality_rules, op10_minhash_near_dedup, op11_sentencepiece, op12_ranked_search,
        op13_spelling_variants,
    )
}
