"""A corpus in five stages: language, near-duplicates, personal data, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Stages run one after the other over all that their predecessor kept, each result written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, language_id, mixing, pii, simhash
from seqloom.plans.durable import materialise, scratch

#: The stages hold a trained network and BPE merges, which SQL can't express.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows; it learns from the documents' own labels."""
    return language_id.keep_known(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a similarity of 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text where it was set."""
    found = pii.find_pii(docs, out_col="_sl_spans")
    text = found.withColumn("text", pii.redact(F.col("text"), F.col("_sl_spans")))
    size = F.when(F.size("_sl_spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return text.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; all documents of a source alike, so short ones aren't given up for
    copies of long ones."""
    return mixing.mix(docs, doc_weight=F.lit(1))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.round_trip(docs, path))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as own:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as inner:  # all that a stage has made but its result goes with it
                docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
                inner.keep(docs)
        own.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
