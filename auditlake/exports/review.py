"""Pull request reviews: check runs, annotations and comments."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.labels import SEVERITIES, annotation_level
from auditlake.operators.corpus import display_path
from auditlake.operators.enrich import advice_join
from auditlake.skew import lookup_join

FAILED = "SECURITY GATE FAILED"


def pr_check_run(pr_events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One check run per event from its repository's counts and gate status."""
    joined = lookup_join(
        pr_events, verdicts.select("repo", *SEVERITIES, "gate_status"), ["repo"], ["commit_sha", "pr_number"]
    ).na.fill(0, SEVERITIES)
    failed = F.coalesce(F.col("gate_status") == FAILED, F.lit(False)) | (F.col("critical") > 0) | (F.col("high") > 0)
    summary = F.format_string(
        "%d Critical, %d High, %d Medium, %d Low findings detected.", *[F.col(s) for s in SEVERITIES]
    )
    return joined.withColumns(
        {
            "conclusion": F.when(failed, "failure").otherwise("success"),
            "title": F.when(failed, "Security Gate Failed").otherwise("Security Gate Passed"),
            "summary": summary,
        }
    ).drop("gate_status")


def pr_targets(pr_events: DataFrame) -> DataFrame:
    """Each pull request (repo, pr_number) with the commit and branch of its newest event."""
    newest = F.max_by(F.struct("commit_sha", "branch"), F.struct("ts", "ord"))
    return pr_events.groupBy("repo", "pr_number").agg(newest.alias("e")).select("repo", "pr_number", "e.*")


def pr_scan_join(pr_events: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of the repositories that have a pull request, each once.

    All pull requests of a repository see the same findings. Their annotations and comments are made once per
    repository; ``pr_delivery`` brings them to the pull requests of ``pr_targets`` that a consumer serves.
    """
    return lookup_join(findings, pr_events.select("repo").distinct(), ["repo"], ["file", "line", "cwe"], "left_semi")


def pr_delivery(notes: DataFrame, targets: DataFrame) -> DataFrame:
    """Annotations or comments for each of the given pull requests."""
    return lookup_join(notes, targets, ["repo"], [c for c in notes.columns if c != "repo"], "inner")


def pr_annotations(scanned: DataFrame, templates: DataFrame) -> DataFrame:
    """Annotation per finding of ``pr_scan_join``: place, level, title and message."""
    rows = advice_join(scanned.withColumn("cwe", F.coalesce("cwe", F.lit("CWE-999"))), templates)
    line = F.coalesce("line", F.lit(1))
    text = F.coalesce("description", F.lit("Security vulnerability detected."))
    return rows.select(
        "repo",
        display_path(F.col("repo"), F.col("file")).alias("path"),
        line.alias("start_line"),
        line.alias("end_line"),
        annotation_level(F.col("severity")).alias("annotation_level"),
        F.concat("cwe", F.lit(": "), F.coalesce("rule", F.lit("Vulnerability"))).alias("title"),
        F.concat(text, F.lit("\n\nSuggested remediation:\n"), "advice").alias("message"),
    )


def pr_comments(scanned: DataFrame, templates: DataFrame) -> DataFrame:
    """Comment per finding of ``pr_scan_join``."""
    rows = advice_join(scanned.withColumn("cwe", F.coalesce("cwe", F.lit("CWE-999"))), templates)
    text = F.coalesce("description", F.lit("Security vulnerability detected."))
    return rows.select(
        "repo",
        display_path(F.col("repo"), F.col("file")).alias("file"),
        F.coalesce("line", F.lit(1)).alias("line"),
        F.concat(
            F.lit("### ⚠️ "), "cwe", F.lit("\n\n"), text, F.lit("\n\n**Suggested remediation:**\n"), "advice"
        ).alias("body"),
    )
