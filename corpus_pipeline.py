"""Training-corpus pipeline: toxicity filter, exact dedup, SimHash near-dedup, mixing to target weights, BPE.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows of its predecessor; ``run`` writes every stage's
result to the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwise.llm import bpe, exact_dedup, mixing, simhash, toxicity
from driftwise.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject, trained on the labels of ``sf_dir``."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text: the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of 3-word SimHash links at 2 or fewer bits: the one with the least doc_id."""
    return simhash.drop_near_copies(docs, shingle=3, radius=2)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as the balanced sample takes it (0 to 3 times)."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, counts and round-trip digests of every document of the mix."""
    return bpe.token_digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The stages hold trained, sampled and iterative steps that SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
