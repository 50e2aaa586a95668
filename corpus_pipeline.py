"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. language: documents whose text has no letter, or whose language is less likely than not, go.
2. exact: of equal texts the row with the largest doc_id stays.
3. near: of documents linked by five-word shingles at 0.8 or more, the smallest doc_id stays.
4. mix: words of the sources in proportion to their target weights.
5. tokens: byte-level BPE ids of what the mix took, decoded again to verify them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, exact_dedup, langid, mixing
from factloom.llm.near_dedup import near_duplicates
from factloom.llm.queries import tokenizer_file
from factloom.llm.runtime import small, table

LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows whose text is null or has no letter, or whose likeliest language has a probability below one half.

    All columns stay as they are, also those named like the classifier's. Rows with equal text, and so
    rows that repeat, share their fate; there are no ties to break. Where no language can be learned
    (an empty table, no lang) only texts that are null or without a letter go.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    own = {c: f"__own_{c}" for c in docs.columns if c in ("lang_pred", "score")}
    found = langid.identify(docs.withColumnsRenamed(own), model)
    found = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal text (null counts as empty) the one with the largest doc_id, a null id below all; of repeated rows one.

    All columns stay as they are; an empty table stays empty.
    """
    return exact_dedup.drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more the smallest doc_id, linked over others too.

    Rows without doc_id come after all others, in the order of their texts' hashes, and are one document
    if their texts are equal. Null and empty texts link with nothing and stay. Rows that repeat with
    their doc_id are one document and stay or go together. All columns stay as they are.
    """
    stand_in = F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = docs.withColumn("__near_key", F.coalesce(F.col("doc_id").cast("long"), stand_in))
    gone = near_duplicates(keyed.select(F.col("__near_key").alias("doc_id"), "text"), width=5, percent=80).filter("not kept")
    gone = small(table(gone.select(F.col("doc_id").alias("__near_key")).distinct()))
    kept = keyed.join(gone, "__near_key", "left_anti")
    named, nameless = kept.filter("doc_id is not null"), kept.filter("doc_id is null").dropDuplicates(["__near_key"])
    return named.unionByName(nameless).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the sources in proportion to their weights, as documents with the columns of ``docs``; see ``mixed_documents``.

    Texts that are null or without words have nothing to give and go. Of rows that repeat one carries the
    words of all. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids and whether these decode to the text again; null text has no ids.

    One row for each row of ``docs``, those that repeat too; other columns go.
    """
    encoded = bpe.encode_documents(docs, tokenizer_file())
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: Language ID, near duplicates and the mix have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = table(docs)
    return docs
