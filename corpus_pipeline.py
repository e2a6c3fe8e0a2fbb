"""The corpus pipeline: quality, near copies, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
documents. The classifier's rejects go, one document of each group of near copies stays, secrets are
masked in the text, the mixture's rows replace the documents it draws from, and what is left is packed
into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surfacescan.llm import jaccard, mixing, packing, quality, secrets
from surfacescan.llm.common import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, scores KEEP or more."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join over five-word sets at 0.8 or more (op8's contract, four words at 0.85, binds op8 alone)."""
    return jaccard.deduplicated(docs, n=5, threshold=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, reported spans masked."""
    return secrets.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents: a row for each document and epoch, its text the words that are taken."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, each with its sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
