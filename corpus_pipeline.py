"""A training corpus in five stages, each the next one's documents.

Every stage reads all rows its predecessor kept and its decisions take effect:
rejected documents go, one document of each near-duplicate group stays,
personal data is replaced in the texts, the mixture follows the target weights,
and the last stage returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm.bpe import encode_documents
from tributary.llm.common import cut
from tributary.llm.mixing import mix
from tributary.llm.pii_sanitise import redact
from tributary.llm.quality_rules import keep_good
from tributary.llm.simhash_dedup import keep_one


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 over shingles of five words."""
    return keep_one(docs, similarity=0.8, shingle=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data and disclosing terms replaced."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken at rates that bring the domains to their target shares."""
    return mix(docs, _labels(spark, sf_dir))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    return encode_documents(docs, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: The mixture is fitted by descent, which SQL can't express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
