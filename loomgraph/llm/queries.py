"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, chat, codes, fingerprint, langid, media, mixing, nearcopy, pii, toxicity
from loomgraph.llm.common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_digests(chat.read_chats(chat.format_chats(rows.unionByName(probe))))


def tokenizer_file(name: str) -> str:
    """A file of a public tokenizer; the files are on every machine and never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.stored(spark, table(spark, sf_dir, "documents")))


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("word_bpe_49k.json")
    return bpe.digests(bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents"), path), path))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = codes.coded(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopy.near_classes(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), langid.fold(F.col("doc_id"), 5) == 0
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), langid.fold(F.col("doc_id"), 4) == 2
    return langid.predict(docs, langid.learn(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_media_columns, op3_bpe_encoding, op4_personal_data, op5_token_codes, op6_near_copies, op7_source_mixing, op8_toxicity, op9_language_id, op10_document_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.CHAT_SQL, "op7_source_mixing": mixing.MIX_SQL}
