"""Registered queries: each operator over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm.common import stored, word_count
from auditlake.llm.conversations import diagnosed, repaired
from auditlake.llm.exact_dedup import exact_groups
from auditlake.llm.language_id import languages
from auditlake.llm.licence_scan import licensed
from auditlake.llm.lm_scoring import scored
from auditlake.llm.mixing import mixed
from auditlake.llm.packing import packed
from auditlake.llm.quality import quality
from auditlake.llm.secret_model import joined, secrets
from auditlake.llm.sharding import byte_shards
from auditlake.llm.simhash import near_groups
from auditlake.llm.spelling import variants
from auditlake.llm.token_files import token_files

#: Shards of the sharding query.
SHARDS = 24
#: Tokens of a training sequence.
SEQUENCE = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), SEQUENCE)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = byte_shards(documents(spark, sf_dir), SHARDS)
    return shards.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", word_count().alias("size"))
    return mixed(sized, "mix").select("doc_id", "size", "source_size", "target", "taken")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults made by a hash of conv_id and turn: dropped, emptied, unended, repeated and relabelled rows."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                       F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("fate <> 0").select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


def turn_digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` of a conversation's turns, newline-joined. Partitions hold whole conversations in order: turns pass by one at a time."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for batch in batches:
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if digest is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "replace"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([d for _, d in out])], ["conv_id", "repaired_sha256"])
                out = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return turns.mapInArrow(fold, "conv_id long, repaired_sha256 string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(given)
    diagnosis = stored(diagnosed(rows), "diagnosis")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = (
        given.select("conv_id")
        .unionByName(diagnosis, allowMissingColumns=True)
        .unionByName(turn_digests(repaired(rows, diagnosis)), allowMissingColumns=True)
    )
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()} | {c: 0 for c in counts}
    return parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in [*counts, "audit", "repaired_sha256"]]).fillna(none)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_sharding": op3_sharding,
    "op4_licence_scan": op4_licence_scan,
    "op5_mixing": op5_mixing,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_files": op7_token_files,
    "op8_language_id": op8_language_id,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}
