"""The training-data pipeline over documents: STAGES in order, each on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from filmloom.llm import minhash, packing, secret_scan, suffix_dedup, toxicity
from filmloom.llm.common import keeping_columns, ready, saved

TOXIC = 0.5
VOCABULARY = "byte_bpe_50k.json"
# The stage's own measure of near copies: at least 80 per cent of all shingles of five words; op8 has one of its own.
NEAR = {"width": 5, "least": 80, "tables": 16}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from `labels` outside its held-out fold."""
    ready(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    @keeping_columns
    def clean(rows: DataFrame) -> DataFrame:
        return toxicity.scored(rows, model, rows.columns, "toxic").filter(F.col("toxic") < TOXIC).drop("toxic")

    return clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the group's least id, once."""
    ready(spark)
    return minhash.survivors(docs, **NEAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are cut out of every document."""
    ready(spark)
    return suffix_dedup.cleaned(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is replaced by a mark; all documents stay."""
    ready(spark)
    return secret_scan.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    ready(spark)
    return packing.packed(docs, public_tokenizers.path(VOCABULARY), remembered=200_000)  # workers also serve the other stages


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

# Learnt scores, masks of inferred formats and token ids can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written to the shared folder and read again."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
