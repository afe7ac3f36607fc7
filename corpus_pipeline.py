"""The corpus pipeline: from documents to packed training sequences.

Each stage works on what the one before kept. ``run`` writes every stage's rows and reads them again, so a lost
executor repeats one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import stored
from auditlake.llm.exact_dedup import without_copies
from auditlake.llm.language_id import with_language
from auditlake.llm.mixing import mixture
from auditlake.llm.packing import packed
from auditlake.llm.simhash import one_of_each

#: Tokens of a training sequence.
SEQUENCE = 1024


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those with more n-grams foreign to the predicted language than clean texts of their length have."""
    return with_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) one row stays."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash fingerprints the row with the smallest doc_id stays."""
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's budget takes them: none, once or twice."""
    return mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their training sequence and place in it."""
    return packed(docs, SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: Learned predictions, fingerprints and token ids are beyond SQL: the tests compare with a brute-force version.
ORACLE_SQL = None
