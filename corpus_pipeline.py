"""A training-data pipeline: quality, near-duplicates, repeated strings, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of `documents`; the last returns packed
pieces. SQL has no form of near-copy components, suffix sorting, tagging or
tokenisation, so ORACLE_SQL is None; tests hold the stages against brute force.

Defined cases: a null text is the empty text, which the quality rules reject; a very
long text is read whole by every stage; of near copies the smallest id stays, of rows
that repeat an id the least text hash, and of rows that repeat id and text one; rows
without an id are no copies of any other; an empty table gives no rows; further
columns are kept as they are, whatever their names, by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import nearcopies, packing, quality, secrets, suffixes
from textloom.llm.common import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the smallest id."""
    return nearcopies.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that stand elsewhere too go."""
    return suffixes.without_repeats(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as op3 returns them."""
    return packing.digest(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeated_strings", repeated_strings), ("secret_spans", secret_spans), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
