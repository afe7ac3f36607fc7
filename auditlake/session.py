"""Session settings the jobs are written for."""

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """A session with adaptive execution and UTC. Cluster settings stay with spark-submit."""
    builder = (
        SparkSession.builder.appName("auditlake")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Large expressions are built here; recording a Python call site for each part is slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    return builder.getOrCreate()
