"""SARIF 2.1.0: rules, results and the document."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.exports.documents import element_lines, fixed_line, tagged
from auditlake.functions.labels import cwe_help_uri, sarif_level
from auditlake.operators.corpus import display_path

# Fixed values of the format.
SCHEMA_URI = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemas/sarif-schema-2.1.0.json"
VERSION = "2.1.0"


def _cwe() -> Column:
    return F.coalesce(F.col("cwe"), F.lit("CWE-999"))


def _rule_id() -> Column:
    return F.coalesce(F.col("rule"), _cwe())


def _rule_columns() -> list[Column]:
    return [
        F.translate(_rule_id(), "-", "_").alias("name"),
        F.concat(_cwe(), F.lit(": "), F.coalesce("cwe_title", F.lit("Vulnerability"))).alias("short_description"),
        F.coalesce("cwe_description", "description", F.lit("Vulnerability detected.")).alias("full_description"),
        cwe_help_uri(_cwe()).alias("help_uri"),
    ]


def _result_columns() -> list[Column]:
    line = F.coalesce("line", F.lit(1))
    file = F.when(F.col("file").isNull(), "unknown").otherwise(display_path(F.col("repo"), F.col("file")))
    return [
        sarif_level(F.col("severity")).alias("level"),
        F.coalesce("description", F.lit("Vulnerability detected.")).alias("message"),
        file.alias("uri"),
        line.alias("start_line"),
        line.alias("end_line"),
    ]


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules per repository with the texts of the first finding of each."""
    return (
        findings.select("repo", _rule_id().alias("rule_id"), F.struct(*_rule_columns(), F.col("ord")).alias("r"))
        .groupBy("repo", "rule_id")
        .agg(F.min_by("r", "r.ord").alias("r"))
        .select("repo", "rule_id", "r.*")
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result per finding: rule, level, message and place."""
    return findings.select("repo", "ord", _rule_id().alias("rule_id"), *_result_columns())


def sarif_export(
    findings: DataFrame,
    repos: DataFrame,
    tool_name: str = "auditlake",
    tool_version: str = "1.0.0",
    information_uri: str | None = None,
) -> DataFrame:
    """One document per repository as lines (repo, part, ord, line)."""
    ord_type = dict(findings.dtypes)["ord"]

    def text(name: str) -> Column:
        return F.struct(F.col(name).alias("text"))

    rule = F.struct(
        F.col("rule_id").alias("id"),
        "name",
        text("short_description").alias("shortDescription"),
        text("full_description").alias("fullDescription"),
        F.col("help_uri").alias("helpUri"),
    )
    place = F.struct(
        F.struct(
            F.struct("uri").alias("artifactLocation"),
            F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region"),
        ).alias("physicalLocation")
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        "level",
        text("message").alias("message"),
        F.array(place).alias("locations"),
    )
    driver = {"name": tool_name, "semanticVersion": tool_version}
    if information_uri:
        driver["informationUri"] = information_uri
    about = ",".join(f'"{k}":"{v}"' for k, v in driver.items())
    opening = f'{{"$schema":"{SCHEMA_URI}","version":"{VERSION}","runs":[{{"tool":{{"driver":{{{about},"rules":['
    rows = findings.select("repo", "ord", _rule_id().alias("rule_id"), *_rule_columns(), *_result_columns())
    parts = [
        fixed_line(repos, 0, F.lit(opening), ord_type),
        element_lines(rows, tagged(1, rule, key=F.col("rule_id")), tagged(3, result)),
        fixed_line(repos, 2, F.lit(']}},"results":['), ord_type),
        fixed_line(repos, 4, F.lit("]}]}"), ord_type),
    ]
    return reduce(DataFrame.unionByName, parts)
