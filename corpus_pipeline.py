"""A training corpus from documents: toxicity, exact and near duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each result to the shared folder and gives it
to the next. SQL can't express the pipeline (a learned classifier, SimHash, byte-level BPE), so tests hold it against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.llm import bpe, exact_dedup, mixing, simhash, toxicity
from kymo.llm.common import finished, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels that aren't held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.is_held_out())
    return toxicity.drop_toxic(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their targets; none is cut."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids of each document, and digests of them and of the text that they decode to."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("mixing to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's files are removed when the next one is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = before = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.split()[0], before)
    return STAGES[-1][1](spark, docs, sf_dir)
