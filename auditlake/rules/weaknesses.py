"""Weakness names and advice.

``cwe_dim`` holds short texts for the weaknesses the built-in rules use; pass the complete
public catalog as a table with the same columns to cover every id.
"""

from pyspark.sql import DataFrame, SparkSession

from auditlake.rules.tables import literal_table

CWE_SCHEMA = "cwe_number INT, title STRING, description STRING"
GUIDANCE_SCHEMA = "cwe STRING, remediation STRING"

CWE_TEXTS = [
    (77, "Command Injection", "Input reaches a command interpreter without neutralized special elements."),
    (78, "OS Command Injection", "Input becomes part of an operating system command."),
    (79, "Cross-site Scripting", "Input is placed in a web page without neutralization."),
    (89, "SQL Injection", "Input becomes part of a database query."),
    (94, "Code Injection", "Input is executed as program code."),
    (250, "Execution with Unnecessary Privileges", "A process has more rights than its task needs."),
    (284, "Improper Access Control", "Access to a resource is not restricted to those allowed."),
    (295, "Improper Certificate Validation", "A certificate is not, or not correctly, validated."),
    (311, "Missing Encryption of Sensitive Data", "Sensitive data is stored or sent in clear text."),
    (502, "Deserialization of Untrusted Data", "Untrusted data is deserialized without checks."),
    (798, "Use of Hard-coded Credentials", "A password or key is part of the source code."),
    (1104, "Use of Unmaintained Third Party Components", "A dependency is outdated or unsupported."),
]

# Texts for ids that are not in the table.
UNKNOWN_ID = "Unknown CWE identifier."
NOT_FOUND = "Vulnerability description not found in local database. Please verify CWE ID."
NO_DESCRIPTION = "No description available."

# Advice per weakness and the advice for all others.
GUIDANCE = {
    "CWE-78": "Avoid executing system shell commands. Use python standard library modules (e.g., subprocess with shell=False and pass arguments as a list) or native APIs.",
    "CWE-94": "Avoid dynamic code execution (eval, exec). Use safe parsing alternatives (e.g., ast.literal_eval or json deserialization) instead.",
    "CWE-295": "Ensure SSL certificate verification is enabled (do not set verify=False in requests or equivalent connection libraries).",
    "CWE-502": "Do not deserialize untrusted data using standard library pickle or yaml.load. Use secure formats like JSON, or yaml.safe_load.",
    "CWE-77": "Sanitize all parameters passed to external commands. Avoid dynamic string building; use parameterized executions or API-level boundaries.",
    "CWE-79": "Use contextual auto-escaping templating engines (e.g., Jinja2, React) and sanitize user inputs before rendering them on UI web pages.",
    "CWE-798": "Never hardcode sensitive credentials, access keys, or API tokens. Utilize secure environment variables, encrypted vault services (e.g., AWS Secrets Manager, GCP Secret Manager), or externalized configuration.",
}
DEFAULT_GUIDANCE = "Perform strict input validation, enforce boundary/type checking, and implement strict output encoding/sanitization for all external inputs."


def cwe_dim(spark: SparkSession) -> DataFrame:
    rows = [{"cwe_number": n, "title": t, "description": d} for n, t, d in CWE_TEXTS]
    return literal_table(spark, rows, CWE_SCHEMA)


def guidance(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, [{"cwe": c, "remediation": r} for c, r in GUIDANCE.items()], GUIDANCE_SCHEMA
    )
