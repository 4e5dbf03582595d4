"""A corpus pipeline of five stages over documents, each by an operator of loomgraph.llm.

Stages take (spark, docs, sf_dir) and return a DataFrame; each result is written and read as the next stage's
documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, langid, mixing, nearcopy, pii
from loomgraph.llm.common import cut
from loomgraph.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected if no language was found, or if its mean probability is above that of a guess among the
#: languages by less than this part of the way to certainty.
LEAST_MARGIN = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, or in which no language prevails. Where no row has a language, nothing can be
    learned, and only documents without letters go."""
    net = langid.learn(docs)
    if net is None:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    d = langid.predict(docs.select(*COLUMNS), net, keep=COLUMNS)
    guess = 1 / len(net.classes)
    least = guess + LEAST_MARGIN * (1 - guess) if len(net.classes) > 1 else 0.0
    return d.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return nearcopy.one_of_each(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text, a null text stays null."""
    d = pii.detect(docs, keep=COLUMNS, with_text=True)
    d = d.withColumn("text", F.when(F.col("text").isNotNull(), F.col("redacted")))
    return d.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document."""
    path = tokenizer_file("word_bpe_49k.json")
    d = bpe.encode_documents(docs, path, keep=("doc_id", "source"))
    return d.select("doc_id", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


STAGES = [("language_id", language), ("near_copies", near_copies), ("personal_data", personal_data), ("source_mixing", mixture), ("bpe_encoding", token_ids)]

#: The stages of models and signatures have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
