"""Pull request events as a stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.exports.review import pr_check_run
from auditlake.sources.reports import ingest_pr_event


def stream_pr_events(bodies: DataFrame, verdicts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Check runs for a stream of webhook bodies (body, ts, ...) against stored verdicts.

    A webhook may be delivered again; within the delay only the first event of a
    (repo, pull request, commit) passes. The state holds the events of one delay.
    """
    events = ingest_pr_event(bodies.withColumn("ts", F.col("ts").cast("timestamp")))
    first = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["repo", "pr_number", "commit_sha"])
    return pr_check_run(first, verdicts)
