"""A corpus pipeline: quality classifier, near-duplicate removal, secret masking, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents, with any others that docs has. Null and blank texts are rejected by the first stage; to the later
ones they are empty texts. A null id is an id like any other, but a copy with an id is kept before it. Rows that repeat are
copies of one document. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import mixing, near, packing, quality, secrets
from tidelog.llm.common import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard similarity of at least 0.8) the document with the smallest id stays.

    Candidates come from fingerprints of words (vptree.search_alike): dealt by runs of bits, and searched by the vantage-point
    trees of the SimHash operator where very many are alike in one.
    """
    return near.keep_first(docs, near.near_copies(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Random-looking credentials of fewer owners than a shared value has are masked; every document stays."""
    return secrets.mask_live(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated at their source's rate and shuffled."""
    return mixing.poisson_mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: A fitted classifier, 64-bit hashes and a tokenizer are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
