"""Risk score, severity counts and the policy gate."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import config
from auditlake.functions.labels import SEVERITIES, cvss_base, exploitability, risk_band
from auditlake.skew import lookup_join


def _factor(text: str, kind: str) -> Column:
    return F.lit(text).cast(kind)


def risk_score(findings: DataFrame) -> DataFrame:
    """Add cvss, exploitability and risk_score, and replace the severity by the risk band.

    Needs cwe, confidence, reachable and internet_exposed ('YES'/'NO'). All factors are exact
    decimals, so the rounding does not depend on the order of the multiplication.
    """
    own = F.col("cvss") if "cvss" in findings.columns else None
    level = F.col("exploitability")
    expl = (
        F.when(level == "HIGH", _factor("1.00", "decimal(3,2)"))
        .when(level == "MEDIUM", _factor("0.85", "decimal(3,2)"))
        .otherwise(_factor("0.70", "decimal(3,2)"))
    )
    reach = F.when(F.col("reachable") == "YES", _factor("1.0", "decimal(2,1)")).otherwise(
        _factor("0.5", "decimal(2,1)")
    )
    seen = F.when(F.col("internet_exposed") == "YES", _factor("1.0", "decimal(2,1)")).otherwise(
        _factor("0.7", "decimal(2,1)")
    )
    score = F.round(
        F.col("cvss") * expl * reach * F.col("confidence").cast("decimal(3,0)") * seen
        * _factor("0.01", "decimal(3,2)"),
        1,
    ).cast("decimal(3,1)")
    return (
        findings.withColumn("cvss", cvss_base(F.col("cwe"), own))
        .withColumn("exploitability", exploitability(F.col("cwe")))
        .withColumn("risk_score", score)
        .withColumn("severity", risk_band(F.col("risk_score")))
    )


def add_exposure(findings: DataFrame, exposed: DataFrame) -> DataFrame:
    """Attach the repository's exposure as YES or NO (NO if the repository has no files)."""
    joined = lookup_join(findings, exposed, ["repo"], ["file", "line", "cwe"])
    flag = F.coalesce(F.col("internet_exposed"), F.lit(False))
    return joined.withColumn("internet_exposed", F.when(flag, "YES").otherwise("NO"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Number of findings per repository and band, zeros included."""
    return findings.groupBy("repo").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )


def gate(counts: DataFrame, policies: DataFrame) -> DataFrame:
    """Policy verdict per repository with its reasons in policy order.

    ``policies`` has one resolved row per repository (``policy_merge``). A repository
    without a policy row is judged by the defaults, one without findings by zero counts.
    """
    joined = counts.join(policies.select("repo", "fail_on", "thresholds"), "repo", "full_outer")
    limits = F.coalesce(F.col("thresholds"), default_thresholds())
    fail_on = F.coalesce(F.col("fail_on"), F.array(*[F.lit(s) for s in config.DEFAULT_FAIL_ON]))

    def count_of(sev: Column) -> Column:
        found = F.when(F.lit(False), F.lit(0).cast("bigint"))
        for name in SEVERITIES:
            found = found.when(F.lower(sev) == name, F.col(name))
        return F.coalesce(found, F.lit(0).cast("bigint"))

    def over(t: Column) -> Column:
        return F.concat(
            F.upper(t["sev"]),
            F.lit(" findings count ("),
            count_of(t["sev"]).cast("string"),
            F.lit(") exceeds threshold ("),
            t["limit"].cast("string"),
            F.lit(")"),
        )

    def forbidden(sev: Column) -> Column:
        return F.concat(
            F.lit("Security policy fails on "),
            F.upper(sev),
            F.lit(" severity ("),
            count_of(sev).cast("string"),
            F.lit(" found)"),
        )

    named = F.transform(limits, lambda t: t["sev"])
    reasons = F.concat(
        F.transform(F.filter(limits, lambda t: count_of(t["sev"]) > t["limit"]), over),
        F.transform(
            F.filter(fail_on, lambda s: ~F.array_contains(named, F.lower(s)) & (count_of(s) > 0)), forbidden
        ),
    )
    zeros = [F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in SEVERITIES]
    return joined.select("repo", *zeros, reasons.alias("gate_reasons")).withColumn(
        "gate_status", F.when(F.size("gate_reasons") > 0, "SECURITY GATE FAILED").otherwise("PASS")
    )


def default_thresholds() -> Column:
    return F.array(
        *[
            F.struct(F.lit(sev).alias("sev"), F.lit(limit).alias("limit"))
            for sev, limit in config.DEFAULT_THRESHOLDS
        ]
    )


def report_summary(raw: DataFrame, deduplicated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per repository: findings after deduplication, weaknesses reported before it, risk level.

    The weakness list is made from distinct ids, so its size is that of the id catalog.
    """
    covered = (
        raw.select("repo", "cwe")
        .distinct()
        .groupBy("repo")
        .agg(F.array_sort(F.collect_list("cwe")).alias("covered_cwes"))
    )
    kept = deduplicated.groupBy("repo").agg(F.count(F.lit(1)).alias("finding_count"))
    joined = verdicts.select("repo", "gate_status").join(kept, "repo", "left").join(covered, "repo", "left")
    risky = (F.col("gate_status") != "PASS") | F.col("covered_cwes").isNotNull()
    return joined.select(
        "repo",
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        F.coalesce("covered_cwes", F.array().cast("array<string>")).alias("covered_cwes"),
        F.when(risky, "high").otherwise("low").alias("risk_level"),
        "gate_status",
    )


def dashboard_overview(findings: DataFrame) -> DataFrame:
    """Per repository: total, critical plus high, a score of ten per finding up to 100, its level."""
    totals = findings.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("critical_high"),
    )
    score = F.least(F.lit(100), F.col("total") * 10)
    return totals.withColumn("risk_score", score.cast("int")).withColumns(
        {
            "risk_level": F.when(F.col("risk_score") > 70, "High")
            .when(F.col("risk_score") > 30, "Medium")
            .otherwise("Low"),
            "risk_message": F.when(F.col("risk_score") > 70, "Requires immediate attention")
            .when(F.col("risk_score") > 30, "Review findings")
            .otherwise("Secure"),
        }
    )


def ranked_findings(findings: DataFrame, shown: list[str] = SEVERITIES) -> DataFrame:
    """Findings of the shown severities from critical to low, in report order within one."""
    sev = F.lower(F.coalesce(F.col("severity"), F.lit("low")))
    rank = F.when(F.lit(False), 0)
    for i, name in enumerate(SEVERITIES):
        rank = rank.when(sev == name, i)
    return (
        findings.withColumn("rank", rank)
        .filter(F.col("rank").isNotNull() & sev.isin(shown))
        .orderBy("rank", "ord")
    )
