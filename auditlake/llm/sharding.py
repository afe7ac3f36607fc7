"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import body, running_totals, stored

#: Bytes a row has besides its text.
ROW_BYTES = 8


def byte_shards(docs: DataFrame, shards: int) -> DataFrame:
    """Assign each row to one of ``shards`` contiguous ranges of nearly equal bytes: doc_id, size, text_crc32, shard, slot.

    Order: MD5 of the text, then doc_id (null first), so equal texts are neighbours and a group of copies is cut only
    where a shard ends. A row belongs to the shard in which its middle byte falls: shard sizes differ from the target by
    at most one row at either end. ``slot`` counts rows from 0 in each shard. A null text is empty; repeated rows take
    one slot each; no rows give no rows; a row larger than a shard leaves neighbours empty. Other columns are not read.
    """
    text = body()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
    )
    placed = running_totals(rows, ["digest", "doc_id"], ["size"])
    total = placed.agg(F.sum("size")).first()[0] or 1
    # Twice the middle byte over twice the total, in whole numbers.
    middle = (F.col("size_before") * 2 + F.col("size")).cast("decimal(38,0)") * shards
    placed = stored(
        placed.withColumn("shard", F.floor(middle / F.lit(2 * total).cast("decimal(38,0)")).cast("int")).drop("digest", "size_before"),
        "shards",
    )
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # a row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot")
    )
