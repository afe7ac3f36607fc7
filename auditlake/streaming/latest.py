"""The newest scan per repository, kept up to date from a stream of scans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from auditlake.operators.history import latest_scan
from auditlake.streaming.published import COMPACT, POINTER, PublishedFolder, next_version, tables

__all__ = ["COMPACT", "POINTER", "current_latest", "start_stream_latest"]


def start_stream_latest(scans: DataFrame, out: str, checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """Keep the newest-scan table below ``out`` after each batch.

    The state is one row per repository. A batch writes its changed rows to a folder of its own; every ``compact`` batches the
    snapshot and the changes since become the next snapshot. Nothing counts until the pointer names it, so a batch that failed half-way
    is written again, and one that is published already changes nothing. Folders that the version before last alone used are removed.
    """
    spark = scans.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = PublishedFolder(spark, out)
        now = folder.pointer()
        if batch_id <= now["batch"]:
            batch.write.format("noop").mode("overwrite").save()  # the stream's own state still takes the rows
            return
        change, snapshot = f"changes-{batch_id}", None
        batch.write.mode("overwrite").parquet(f"{out}/{change}")
        if len(now["changes"]) + 1 >= compact:
            snapshot = f"snapshot-{batch_id}"
            paths = [f"{out}/{t}" for t in [*tables(now), change]]
            latest_scan(spark.read.schema(batch.schema).parquet(*paths)).write.mode("overwrite").parquet(f"{out}/{snapshot}")
        folder.publish(next_version(now, batch_id, change, snapshot))
        folder.remove(now.get("old", []))

    return (
        latest_scan(scans)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_latest(spark: SparkSession, out: str) -> DataFrame:
    """The keyed table as published: the newest snapshot, and fewer than ``compact`` small tables of changes since."""
    published = tables(PublishedFolder(spark, out).pointer())
    if not published:
        raise ValueError(f"no batch has been published below {out}")
    return latest_scan(spark.read.parquet(*[f"{out}/{t}" for t in published]))
