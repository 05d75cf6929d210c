"""A corpus pipeline of five stages over ``documents``: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes each stage's rows as Parquet into the folder of
spark.checkpoint.dir and reads them again, so that a lost executor costs no earlier stage;
the folder of a stage goes once the next one is written.

Cases: null and empty texts pass the first stages, those without words aren't mixed in; rows
with null or shared ids are judged by their own text; of repeated rows one stays; an empty
table gives an empty result; columns beyond those of documents are carried, under any name,
as far as the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cairnflow.llm import mixing, packing, queries, secret_scan, simhash, toxicity
from cairnflow.llm.common import remove, shared_dir, table
from cairnflow.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    ship(spark)
    return toxicity.clean_documents(docs, queries.toxicity_model(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret's characters replaced by a mark."""
    return secret_scan.redact_secrets(docs, queries.secret_model(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The tokenizer and the trained models have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
