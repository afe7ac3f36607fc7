"""Reports of other tools, and review events, as JSON text columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import config
from auditlake.functions.secrets import mask_secret
from auditlake.functions.text import strip
from auditlake.schemas import conform_findings, finding_order

# Defaults for members a report leaves out.
DEFAULT_BANDIT_CWE = "CWE-77"
DEFAULT_CWE = "CWE-999"


def bandit_cwe(cwe_id: Column) -> Column:
    """Weakness of an issue: its id with the prefix, or the default for none, 0 or empty."""
    given = F.nullif(F.nullif(cwe_id, F.lit("")), F.lit("0"))
    prefixed = F.when(F.startswith(given, F.lit("CWE-")), given).otherwise(F.concat(F.lit("CWE-"), given))
    return F.coalesce(prefixed, F.lit(DEFAULT_BANDIT_CWE))


def ingest_bandit(reports: DataFrame) -> DataFrame:
    """Rows (repo, report): the JSON object inside the tool's output, one finding per result."""
    schema = (
        "results ARRAY<STRUCT<filename:STRING,line_number:INT,test_id:STRING,issue_severity:STRING,"
        "issue_cwe:STRUCT<id:STRING>,issue_text:STRING>>"
    )
    document = F.from_json(F.regexp_extract("report", r"(?s)\{.*\}", 0), schema)
    rows = reports.select("repo", F.posexplode(document["results"]).alias("pos", "r"))
    file = F.coalesce(F.col("r.filename"), F.lit(""))
    return conform_findings(
        rows.select(
            "repo",
            file.alias("file"),
            F.col("r.line_number").alias("line"),
            F.coalesce("r.test_id", F.lit("bandit")).alias("rule"),
            bandit_cwe(F.col("r.issue_cwe.id")).alias("cwe"),
            F.lower(F.coalesce("r.issue_severity", F.lit("medium"))).alias("severity"),
            F.coalesce("r.issue_text", F.lit("Bandit detected issue")).alias("description"),
            finding_order(config.SCANNER_RANK["bandit"], file, F.col("r.line_number"), F.col("pos")).alias("ord"),
        )
    )


def ingest_codeql_marker(statuses: DataFrame) -> DataFrame:
    """Rows (repo, tool, status): one marker finding per repository with a finished database."""
    done = statuses.filter((F.col("tool") == "codeql") & (F.col("status") == "database-created"))
    return conform_findings(
        done.select("repo")
        .distinct()
        .select(
            "repo",
            F.lit(".").alias("file"),
            F.lit("codeql-integrated").alias("rule"),
            F.lit("CWE-79").alias("cwe"),
            F.lit("medium").alias("severity"),
            F.lit("CodeQL semantic vulnerability check complete").alias("description"),
            F.lit("").alias("sink"),
            finding_order(config.SCANNER_RANK["codeql"], F.lit("."), F.lit(0), F.lit(0)).alias("ord"),
        )
    )


def ingest_gitleaks(reports: DataFrame) -> DataFrame:
    """Rows (repo, report) with a JSON array of leaks."""
    schema = (
        "ARRAY<STRUCT<Description:STRING,StartLine:INT,Secret:STRING,File:STRING,RuleID:STRING>>"
    )
    rows = reports.select("repo", F.posexplode(F.from_json("report", schema)).alias("pos", "r"))
    provider = F.substring_index(F.lower(F.coalesce("r.RuleID", F.lit("generic"))), "-", 1)
    file = F.coalesce(F.col("r.File"), F.lit(""))
    line = F.coalesce(F.col("r.StartLine"), F.lit(1))
    return conform_findings(
        rows.select(
            "repo",
            file.alias("file"),
            line.alias("line"),
            F.coalesce("r.RuleID", F.lit("gitleaks-secret")).alias("rule"),
            F.lit("CWE-798").alias("cwe"),
            F.lit("critical").alias("severity"),
            F.concat(
                F.lit("Exposed secret detected: "),
                F.coalesce("r.Description", F.lit("Hardcoded credential")),
            ).alias("description"),
            F.lit("SECRET").alias("type"),
            provider.alias("provider"),
            mask_secret(F.coalesce("r.Secret", F.lit("")), provider).alias("secret"),
            finding_order(config.SCANNER_RANK["secret"], file, line, F.col("pos")).alias("ord"),
        )
    )


_OSV = (
    "results ARRAY<STRUCT<source:STRUCT<path:STRING>,packages:ARRAY<STRUCT<"
    "package:STRUCT<name:STRING,version:STRING>,vulnerabilities:ARRAY<STRUCT<"
    "id:STRING,aliases:ARRAY<STRING>,summary:STRING,details:STRING>>>>>>"
)


def _osv_packages(reports: DataFrame) -> DataFrame:
    results = reports.select("repo", F.posexplode(F.from_json("report", _OSV)["results"]).alias("i", "r"))
    return results.select(
        "repo",
        "i",
        F.coalesce("r.source.path", F.lit("")).alias("file"),
        F.posexplode("r.packages").alias("j", "p"),
    ).select(
        "repo",
        "file",
        F.shiftleft(F.col("i").cast("bigint"), 31).bitwiseOR(F.col("j").cast("bigint")).alias("pos"),
        F.coalesce("p.package.name", F.lit("")).alias("package"),
        F.coalesce("p.package.version", F.lit("")).alias("version"),
        F.col("p.vulnerabilities").alias("vulnerabilities"),
    )


def ingest_osv(reports: DataFrame) -> DataFrame:
    """Rows (repo, report): one finding per package and vulnerability."""
    rows = _osv_packages(reports).select("*", F.posexplode("vulnerabilities").alias("k", "v"))
    alias = F.try_element_at(
        F.filter("v.aliases", lambda a: F.startswith(a, F.lit("CVE-"))), F.lit(1)
    )
    summary = F.col("v.summary")

    def critical(text: Column) -> Column:
        return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("critical"))

    return conform_findings(
        rows.select(
            "repo",
            "file",
            F.lit(1).alias("line"),
            F.concat(F.lit("sca-"), F.col("package")).alias("rule"),
            F.lit("CWE-1104").alias("cwe"),
            F.when(critical(summary) | critical(F.col("v.details")), "critical").otherwise("high").alias("severity"),
            F.format_string(
                "Vulnerable dependency %s (%s) detected via OSV: %s",
                F.col("package"),
                F.col("version"),
                F.coalesce(summary, F.lit("Vulnerable package version.")),
            ).alias("description"),
            F.lit("SCA").alias("type"),
            "package",
            F.col("version").alias("installed"),
            F.lit("Matched OSV database").alias("affected"),
            F.coalesce(alias, F.col("v.id"), F.lit("GHSA-unknown")).alias("cve"),
            F.lit("Upgrade dependency").alias("fix"),
            finding_order(config.SCANNER_RANK["sca"], F.col("file"), F.lit(1), F.col("pos"), F.col("k")).alias("ord"),
        )
    )


def ingest_osv_deps(reports: DataFrame) -> DataFrame:
    """Rows (repo, report): the named and versioned packages of the report."""
    named = _osv_packages(reports).filter("package <> '' AND version <> ''")
    return named.select("repo", "file", F.lit(1).alias("line"), "package", "version", "pos")


_AI_FINDING = "STRUCT<line:INT,rule:STRING,cwe:STRING,severity:STRING,description:STRING>"


def _unfenced(content: Column) -> Column:
    """Answer text without a surrounding code fence."""
    text = strip(content)
    fence = "```"
    marked = F.when(
        F.contains(text, F.lit(fence + "json")), F.regexp_replace(text, r"(?s)^.*?```json", "")
    ).otherwise(F.regexp_replace(text, r"(?s)^.*?```", ""))
    closed = F.regexp_replace(marked, r"(?s)```(?!.*```).*$", "")
    return F.when(F.startswith(text, F.lit(fence)), strip(closed)).otherwise(text)


def ai_items(content: Column) -> Column:
    """Array of findings in a model's answer.

    A list is taken as it is; of an object the first member that is a list, in document
    order, or else the object itself; anything else gives none.
    """
    text = _unfenced(content)
    many = f"ARRAY<{_AI_FINDING}>"
    members = F.map_values(F.from_json(text, "MAP<STRING,STRING>"))
    lists = F.filter(
        members, lambda m: F.startswith(strip(m), F.lit("[")) & F.from_json(m, many).isNotNull()
    )
    whole = F.array(F.from_json(text, _AI_FINDING))
    return F.when(F.startswith(text, F.lit("[")), F.from_json(text, many)).when(
        F.startswith(text, F.lit("{")) & members.isNotNull(),
        F.when(F.size(lists) > 0, F.from_json(F.get(lists, F.lit(0)), many)).otherwise(whole),
    )


def ingest_ai_review(answers: DataFrame) -> DataFrame:
    """Rows (repo, file, provider, answer): one finding per item of each answer."""
    rows = answers.select("repo", "file", "provider", F.posexplode(ai_items(F.col("answer"))).alias("pos", "f"))
    return conform_findings(
        rows.select(
            "repo",
            "file",
            F.col("f.line").alias("line"),
            F.coalesce("f.rule", F.concat(F.lit("ai-"), F.col("provider"))).alias("rule"),
            F.coalesce("f.cwe", F.lit(DEFAULT_CWE)).alias("cwe"),
            F.lower(F.coalesce("f.severity", F.lit("medium"))).alias("severity"),
            F.coalesce("f.description", F.lit("AI detected security vulnerability")).alias("description"),
            finding_order(config.SCANNER_RANK["ai"], F.col("file"), F.col("f.line"), F.col("pos")).alias("ord"),
        )
    )


def parse_pr_events(bodies: DataFrame) -> DataFrame:
    """Webhook bodies (body and any other columns) with status 'processed' or 'ignored'.

    Bodies that are not JSON objects are dropped.
    """
    schema = (
        "number BIGINT, repository STRUCT<full_name:STRING>, pull_request MAP<STRING,STRING>, broken STRING"
    )
    event = F.from_json("body", schema, {"columnNameOfCorruptRecord": "broken"})
    request = F.from_json(F.try_element_at("e.pull_request", F.lit("head")), "sha STRING, ref STRING")
    has_request = F.coalesce(F.size("e.pull_request") > 0, F.lit(False))
    return (
        bodies.withColumn("e", event)
        .withColumn("head", request)
        .filter("e.broken IS NULL")
        .withColumns(
            {
                "status": F.when(has_request, "processed").otherwise("ignored"),
                "pr_number": F.coalesce("e.number", F.lit(1)),
                "repo": F.coalesce("e.repository.full_name", F.lit("unknown/repo")),
                "commit_sha": F.coalesce("head.sha", F.lit("unknown-sha")),
                "branch": F.coalesce("head.ref", F.lit("main")),
            }
        )
        .drop("e", "head", "body")
    )


def ingest_pr_event(bodies: DataFrame) -> DataFrame:
    """Pull request events only."""
    return parse_pr_events(bodies).filter("status = 'processed'").drop("status")
