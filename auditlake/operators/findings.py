"""One findings table from all scanners, then one row per place and weakness."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.labels import combined_confidence, detector_name, severity_priority
from auditlake.schemas import conform_findings
from auditlake.skew import lookup_join

KEY = ["repo", "file", "line", "cwe"]


def finding_union(*parts: DataFrame) -> DataFrame:
    """UNION ALL of any scanners' rows."""
    return reduce(lambda a, b: a.unionByName(b), [conform_findings(p) for p in parts])


def finding_defaults(findings: DataFrame) -> DataFrame:
    """Drop source excerpts and fill the advisory id."""
    return findings.drop("code").withColumn("cve", F.coalesce(F.col("cve"), F.lit("N/A")))


def _with_key(findings: DataFrame) -> DataFrame:
    return findings.withColumns(
        {
            "file": F.coalesce(F.col("file"), F.lit("unknown")),
            "cwe": F.coalesce(F.col("cwe"), F.lit("CWE-999")),
        }
    )


def _kind(findings: DataFrame) -> Column:
    return F.col("type") if "type" in findings.columns else F.lit(None).cast("string")


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One row per (repo, file, line, cwe): the representative, and all detectors that agree.

    The representative has the highest severity, then the longest description, then comes
    first; full ties go by the rows' values, so any order of arrival gives the same row. Rows are reduced before the shuffle, so a place reported very often moves one row
    per task; the detector set holds at most one entry per detector name.
    """
    keyed = _with_key(findings)
    carried = [c for c in keyed.columns if c not in KEY]
    rank = F.struct(
        -severity_priority(F.col("severity")),
        -F.length(F.coalesce(F.col("description"), F.lit(""))),
        F.col("ord"),
        F.struct(*[F.col(c) for c in carried if c != "ord"]),
    )
    detectors = F.collect_set(detector_name(F.col("rule"), _kind(findings)))
    grouped = keyed.groupBy(*KEY).agg(
        F.min_by(F.struct(*carried), rank).alias("first"),
        F.array_sort(detectors).alias("detected_by"),
        F.count(F.lit(1)).alias("reports"),
    )
    return grouped.select(*KEY, "first.*", "detected_by", "reports").withColumn(
        "confidence", combined_confidence(F.col("detected_by"))
    )


def detector_set(findings: DataFrame) -> DataFrame:
    """Sorted distinct detectors per place and weakness, with their joint confidence."""
    grouped = (
        _with_key(findings)
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_set(detector_name(F.col("rule"), _kind(findings)))).alias("detected_by"))
    )
    return grouped.withColumn("confidence", combined_confidence(F.col("detected_by")))


def finding_lookup(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """The first finding for each requested fingerprint (requests without one are dropped).

    Findings are reduced to one row per fingerprint first; many requests for the same
    fingerprint are spread over several partitions.
    """
    carried = [c for c in findings.columns if c != "fingerprint"]
    first = (
        findings.groupBy("fingerprint")
        .agg(F.min_by(F.struct(*carried), F.struct("ord", *[c for c in carried if c != "ord"])).alias("first"))
        .select("fingerprint", "first.*")
    )
    return lookup_join(requests, first, ["fingerprint"], ["request_id"], "inner")
