"""Corpus preparation in five stages, each over all that its predecessor kept.

Stages read the five columns of documents; one that is missing is null, others are left out, whatever their names. Null,
empty and blank texts have no language and end with the first stage. Rows with a null doc_id are kept by the stages that
decide by text; near-dedup keeps them, since nothing names their group. Rows that repeat an id are one row after
near-dedup. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm import decontam, language, mixing, simhash, store
from demandlens.llm.util import shared_folder

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
#: A prediction below this probability rejects a document, as no language does.
SURE = 0.5


def documents(docs: DataFrame) -> DataFrame:
    """Just the columns of documents, in their types."""
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model tells with confidence and that fit it; texts that are null or without letters go."""
    docs = documents(docs)
    known = docs.select("doc_id", "text", "lang")
    model = language.train(known.where(~language.held_out(F.col("doc_id"))), floors=True)
    return language.keep_confident(docs, model, SURE)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the smallest doc_id."""
    return simhash.one_of_each(documents(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.without_matches(documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those of no word or beyond their source's budget go."""
    return mixing.mixed_rows(documents(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept corpus as a content-addressed store of token ids, and what its files say of each document."""
    return store.token_store(documents(docs))


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token-ID output", token_stage),
]

#: Several stages have no SQL form (a trained model, XXH64 fingerprints, a tokenizer); tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
