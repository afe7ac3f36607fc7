"""The JSON report of a scan."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.config import SCANNER_RANK
from auditlake.exports.documents import element_lines, fixed_line, tagged, write_documents
from auditlake.operators.corpus import display_path
from auditlake.schemas import finding_order

HIDDEN = ["repo", "ord", "reports"]


def with_order(deps: DataFrame) -> DataFrame:
    """Dependencies with the same kind of sort key as findings."""
    key = finding_order(SCANNER_RANK["sca"], F.col("file"), F.col("line"), F.col("pos"))
    return deps.withColumn("ord", key)


def report_lines(findings: DataFrame, summary: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """One report per repository of ``summary`` as lines: summary, findings, dependencies.

    ``summary`` has one row per repository; every column but repo becomes a member of the
    report's summary. Findings keep their filled columns only (JSON leaves NULLs out).
    """
    ord_type = dict(findings.dtypes)["ord"]
    shown = findings.withColumn("file", display_path(F.col("repo"), F.col("file")))
    element = F.struct(*[F.col(c) for c in shown.columns if c not in HIDDEN])
    head = F.struct(
        F.col("repo").alias("source_path"),
        F.struct(*[F.col(c) for c in summary.columns if c != "repo"]).alias("summary"),
    )
    json = F.to_json(head)
    opening = F.concat(F.substring(json, 1, F.length(json) - 1), F.lit(',"findings":['))
    parts = [
        fixed_line(summary, 0, opening, ord_type),
        element_lines(shown, tagged(1, element)),
    ]
    if deps is not None:
        package = F.struct("package", "version", display_path(F.col("repo"), F.col("file")).alias("file"))
        parts.append(fixed_line(summary, 2, F.lit('],"dependencies":['), ord_type))
        parts.append(element_lines(with_order(deps), tagged(3, package)))
    parts.append(fixed_line(summary, 4, F.lit("]}"), ord_type))
    return reduce(lambda a, b: a.unionByName(b), parts)


def report_export(findings: DataFrame, summary: DataFrame, path: str, deps: DataFrame | None = None) -> None:
    """Write one JSON report per repository below the path."""
    write_documents(report_lines(findings, summary, deps), path)
