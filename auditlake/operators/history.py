"""Scan history: the newest result per target."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_scan(history: DataFrame, keys: list[str] = ["repo"]) -> DataFrame:
    """The newest row per key by (ts, ord). Reduced before the shuffle, no sort."""
    carried = [c for c in history.columns if c not in keys]
    newest = F.max_by(F.struct(*carried), F.struct("ts", "ord"))
    return history.groupBy(*keys).agg(newest.alias("last")).select(*keys, "last.*")


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("ts"), F.desc("ord"))
