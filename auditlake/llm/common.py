"""Shared steps: row numbers, stored tables, distributed prefix sums, contract expressions."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.workspace import fresh_path

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch that Python looks at together, so that memory follows these rows.
SLICE = 256


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, fixes generated values."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def body(name: str = "text") -> Column:
    """The text, empty if null."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(name: str = "text") -> Column:
    """Words of the text, as long."""
    return F.regexp_count(body(name), F.lit(WORD)).cast("long")


def numbered(docs: DataFrame, *columns: Column, label: str) -> DataFrame:
    """Store whole rows as a struct ``row`` beside a row number ``rid`` and further columns.

    The struct keeps columns of any name apart from ours; the stored number tells repeated rows apart.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return stored(docs.select(whole, F.monotonically_increasing_id().alias("rid"), *columns), label)


def running_totals(df: DataFrame, order: list[str], values: list[str], group: str | None = None) -> DataFrame:
    """Global exclusive prefix sums of ``values`` in the order of ``order``, within each ``group`` if named.

    Range-sort, store, sum each partition, add up the partition totals, then number the rows of each
    partition. Adds ``<value>_before`` per value, and ``position`` (rows before). No task sees more than
    its range; the totals table has a row per partition and group. Rows equal in ``order`` are put apart
    by a row number, so that a row repeated many times does not fill one range.
    """
    spark = df.sparkSession
    keys = [group] if group else []
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *[F.col(c) for c in [*keys, *order, "_tie"]])
        .withColumn("_part", F.spark_partition_id())
    )
    rows = stored(ranged, "ranges")
    sums = [F.sum(v).alias(f"_{v}") for v in values]
    totals = rows.groupBy("_part", *keys).agg(*sums, F.count(F.lit(1)).alias("_position"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *keys, *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in [*values, "position"]]
    )
    here = Window.partitionBy("_part", *keys).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "*",
        *[F.coalesce(F.sum(v).over(here), F.lit(0)).alias(f"{v}_before") for v in values],
        F.coalesce(F.count(F.lit(1)).over(here), F.lit(0)).alias("position"),
    )
    joined = local.join(offsets, ["_part", *keys])
    out = [c for c in df.columns]
    return joined.select(
        *out, *[(F.col(f"{v}_before") + F.col(f"_{v}")).alias(f"{v}_before") for v in values],
        (F.col("position") + F.col("_position")).alias("position"),
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a batch, empty where null."""
    return [x if x is not None else "" for x in column.to_pylist()]


def kept_in_worker(key: Any, make: Callable[[], Any]) -> Any:
    """An object that lives as long as its worker process. Functions sent with a job get new globals in each task."""
    held = sys.modules.setdefault("_auditlake_worker", types.ModuleType("_auditlake_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
