"""Exact deduplication: sorted digest runs merged as a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import SPACE, body, numbered, stored

#: Runs merged into one at each level.
FAN_IN = 8
#: A group is spread over several join keys above this share of all rows (so at most 1 / share groups are).
HOT_SHARE = 0.001
HOT_LEAST = 1000
KEY = ["sha", "check_hash", "check_length"]


def fingerprinted(docs: DataFrame) -> list:
    """Digest of the text without white space, two values that verify it, the original's length."""
    text = body()
    normal = F.regexp_replace(text, SPACE + "+", "")
    return [
        F.sha2(normal, 256).alias("sha"),
        F.xxhash64(normal).alias("check_hash"),
        F.char_length(normal).alias("check_length"),
        F.char_length(text).alias("n"),
        F.spark_partition_id().alias("run"),
    ]


def merged(rows: DataFrame) -> DataFrame:
    """One row per digest: ``best`` (its row that stays) and ``group_size``, by merging runs level by level.

    A run is what one partition has read. At level 0 each run is sorted by digest and reduced to one row per
    digest; at each further level FAN_IN neighbouring runs exchange their rows by (merged run, digest) and are
    merged. The minimum over a struct makes Spark aggregate by sorting, before and after each exchange, so both
    sides are sorted runs. Digest, a second hash and the length must all agree for rows to meet. A digest
    in a third of the rows is at most one row per run from level 0 on.
    """
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    level = rows.groupBy("run", *KEY).agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        level = (
            level.withColumn("run", F.floor(F.col("run") / FAN_IN))
            .groupBy("run", *KEY)
            .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
        runs = -(-runs // FAN_IN)
    return level.drop("run")


def decided(rows: DataFrame) -> DataFrame:
    """Each row (rid, doc_id, digest columns) with keep_id, group_size and kept."""
    groups = stored(merged(rows), "groups")
    hot_rows = max(HOT_LEAST, int(rows.count() * HOT_SHARE))
    salts = F.ceil(F.col("group_size") / hot_rows).cast("int")
    # At most 1 / HOT_SHARE groups exceed the share: a broadcast of bounded size.
    hot = groups.where(F.col("group_size") > hot_rows).select(*KEY, salts.alias("salts"))
    salted = rows.join(F.broadcast(hot), KEY, "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("salts")), F.lit(0)).cast("int")
    )
    repeated = groups.withColumn(
        "salt", F.explode(F.when(F.col("group_size") > hot_rows, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0))))
    )
    return salted.join(repeated, [*KEY, "salt"]).select(
        "rid", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same without ASCII white space; null counts as empty, and all empty texts
    are one group. Of a group the row with the most code points stays, then the smallest doc_id (null last),
    then the first read: of fully repeated rows exactly one is kept. No rows give no rows. Other columns are not read.
    """
    rows = stored(
        docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), *fingerprinted(docs)), "digests"
    )
    return decided(rows).drop("rid")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names."""
    rows = numbered(docs, F.col("doc_id"), *fingerprinted(docs), label="digest-rows")
    stay = decided(rows.drop("row")).where("kept").select("rid")
    return rows.join(stay, "rid", "left_semi").select("row.*")
