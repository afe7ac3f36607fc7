"""Built-in vulnerability table; pass a larger one of the same schema to ``sca_match``."""

from pyspark.sql import DataFrame, SparkSession

from auditlake.rules.tables import literal_table

SCHEMA = "package STRING, affected STRING, cve STRING, severity STRING, fix STRING"

# Package, affected versions, advisory, severity, first fixed version.
VULNERABILITIES = [
    ("log4j-core", "<2.15.0", "CVE-2021-44228", "critical", "2.15.0"),
    ("spring-core", "<5.3.18", "CVE-2022-22965", "critical", "5.3.18"),
    ("lodash", "<4.17.21", "CVE-2020-8203", "high", "4.17.21"),
    ("requests", "<2.31.0", "CVE-2023-32681", "medium", "2.31.0"),
    ("urllib3", "<1.26.17", "CVE-2023-43804", "high", "1.26.17"),
    ("django", "<3.2.20", "CVE-2023-41164", "high", "3.2.20"),
    ("express", "<4.19.2", "CVE-2024-29025", "medium", "4.19.2"),
    ("minimist", "<1.2.6", "CVE-2021-44906", "high", "1.2.6"),
    ("cryptography", "<41.0.0", "CVE-2023-23931", "high", "41.0.0"),
    ("openssl", "<3.0.7", "CVE-2022-3602", "high", "3.0.7"),
]


def vuln_db(spark: SparkSession) -> DataFrame:
    rows = [
        {
            "package": package,
            "affected": affected,
            "cve": cve,
            "severity": severity,
            "fix": f"Upgrade dependency to version {fixed} or later",
        }
        for package, affected, cve, severity, fixed in VULNERABILITIES
    ]
    return literal_table(spark, rows, SCHEMA)
