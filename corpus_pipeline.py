"""A corpus pipeline of five operators, each stage written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import discard, discarding, materialize, table
from millrace.llm.mixing import repeat_documents
from millrace.llm.packing import pack
from millrace.llm.pii import fit_pii, redact
from millrace.llm.quality import keep_good
from millrace.llm.queries import TOKENIZERS
from millrace.llm.simhash import WIDE_SHINGLE, one_of_each

#: Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of at least this.
SIMILARITY = (4, 5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return one_of_each(docs, shingle=WIDE_SHINGLE, similarity=SIMILARITY)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return redact(docs, fit_pii(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents appear as often as the mix takes them."""
    return repeat_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return pack(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; a stage's tables are deleted once what follows has read them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with discarding() as made:
            after = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            made.pop()
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, networks and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
