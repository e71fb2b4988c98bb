"""A corpus pipeline in five stages, each over all rows that the stage before it kept.

Junk goes, one document of each group of near duplicates stays, documents that hold a benchmark item go, secrets are
masked, and what is left is encoded. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinward.llm import bpe, decontaminate, jaccard, quality, secrets
from spinward.llm.common import shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the classifier rejects go.

    Null and empty texts are scored by the statistics of a text without a character. Repeated rows stay or go alike; scores of
    0.5 stay. All columns stay as they are; an empty table gives none.
    """
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near duplicates the document of least id stays.

    Rows of equal id and text are one, ties of ids go to the least digest of text. Rows without words are linked with
    nothing, those without an id all stay. All columns stay as they are; an empty table gives none.
    """
    return jaccard.keep_one(docs, jaccard.jaccard_components(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go.

    Null and empty texts hold none and stay. Repeated rows stay or go alike, whatever their ids. All columns stay as they
    are; an empty table gives none, and without items all rows stay.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: secrets are replaced by a mark; n_chars, where there is such a column, follows the new text.

    No row goes. Null texts stay null. Overlapping spans get one mark. All other columns, whatever their names, stay as they
    are; an empty table gives none.
    """
    return secrets.redact_secrets(docs, secrets.train_markov(secrets.labelled_samples(spark)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token ids of what is left, with the digest of the text that they decode to.

    Null and empty texts have no ids. Every row gives one, repeated ones alike; null ids stay null. An empty table gives none.
    """
    made = bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("quality", keep_quality), ("near_duplicates", one_of_each), ("decontaminate", without_benchmark), ("secrets", mask_secrets), ("encode", encode)]

#: The stages train models and follow links of any length, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
