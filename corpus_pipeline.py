"""A corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Defined cases, for every stage: rows with a null id, text, lang or source are kept like others (a null
text counts as empty; empty texts are near-duplicates of each other); repeated rows are rows of their
own but for the near-duplicate stage, which keeps one, and for mixing, which draws them alike; texts
are worked on whole, whatever their length; of linked documents of equal id the first read stays; an
empty table gives an empty table; columns that the stages don't know come back as they were, whatever their names
(packing returns its own columns alone).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import mixing, packing, secret_scan, simhash, toxicity
from colloquy.llm.common import fresh_path, prepare, remove, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go; the others stay as they are."""
    scorer = toxicity.fit(docs, toxicity.train_rows(table(spark, sf_dir, "labels")))
    return toxicity.clean(docs, scorer)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id stays."""
    return simhash.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; no document goes."""
    prepare(spark)
    text = docs.withColumn("text", secret_scan.redact(F.col("text")))
    return text.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(docs.columns) if "n_chars" in docs.columns else text.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's rate says."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizers and learned models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again; a stage's folder goes once the next is written."""
    prepare(spark)
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = fresh_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
