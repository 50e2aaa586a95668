"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, chat, exact_dedup, fingerprint, katz, langid, mixing, near_dedup, repeats, secrets


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(read(spark, sf_dir, "conversations"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.pack_ids(bpe.encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file()))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(read(spark, sf_dir, "documents"))


def op8_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_chat_perspectives": op2_chat_perspectives,
    "op3_fingerprints": op3_fingerprints,
    "op4_secret_scan": op4_secret_scan,
    "op5_language_model": op5_language_model,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bpe": op7_bpe,
    "op8_repeat_removal": op8_repeat_removal,
    "op9_source_mix": op9_source_mix,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL = {
    "op1_near_dedup": near_dedup.ORACLE_SQL,
    "op2_chat_perspectives": chat.ORACLE_SQL,
    "op4_secret_scan": secrets.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
}
