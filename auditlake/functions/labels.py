"""Classification expressions: detectors, scores, bands, links."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import WHITESPACE_CLASS, strip

# Severity base per weakness, and how easily a weakness is exploited.
CVSS_BASE = {
    "CWE-77": "9.8",
    "CWE-78": "9.8",
    "CWE-79": "6.1",
    "CWE-89": "9.8",
    "CWE-94": "9.8",
    "CWE-798": "9.8",
    "CWE-295": "6.5",
    "CWE-502": "9.8",
    "CWE-1104": "7.5",
    "CWE-250": "7.2",
    "CWE-284": "8.5",
    "CWE-311": "5.3",
}
CVSS_DEFAULT = "6.5"
EXPLOIT_HIGH = ["CWE-798", "CWE-284"]
EXPLOIT_MEDIUM = ["CWE-77", "CWE-78", "CWE-79", "CWE-89", "CWE-94", "CWE-502", "CWE-1104"]

# Confidence of each detector.
DETECTOR_CONFIDENCE = {
    "AST": 0.70,
    "Bandit": 0.80,
    "CodeQL": 0.85,
    "AI (OpenAI)": 0.65,
    "AI (Claude)": 0.70,
    "AI (Ollama)": 0.55,
    "AI (Cursor)": 0.60,
    "AI": 0.60,
    "SecretScanner": 0.90,
    "SCA": 0.90,
    "IaCScanner": 0.85,
}
DETECTOR_CONFIDENCE_DEFAULT = 0.60

SEVERITIES = ["critical", "high", "medium", "low"]


def severity_priority(severity: Column) -> Column:
    """4 for critical down to 1 for low, unknown or missing."""
    sev = F.lower(severity)
    return F.when(sev == "critical", 4).when(sev == "high", 3).when(sev == "medium", 2).otherwise(1)


def detector_name(rule: Column, kind: Column) -> Column:
    """Name of the detector a finding counts for; the first matching line decides."""
    r = F.lower(F.coalesce(rule, F.lit("")))
    t = F.upper(F.coalesce(kind, F.lit("")))

    def starts(p: str) -> Column:
        return F.startswith(r, F.lit(p))

    def has(col: Column, p: str) -> Column:
        return F.contains(col, F.lit(p))

    model = F.when(starts("ai-"), F.substring_index(r, "ai-", -1)).otherwise(r)
    ai = (
        F.when(has(model, "openai"), "AI (OpenAI)")
        .when(has(model, "claude"), "AI (Claude)")
        .when(has(model, "ollama"), "AI (Ollama)")
        .when(has(model, "cursor"), "AI (Cursor)")
        .otherwise("AI")
    )
    return (
        F.when(starts("ast-"), "AST")
        .when(starts("bandit-"), "Bandit")
        .when(starts("codeql-"), "CodeQL")
        .when((t == "SCA") | starts("sca-"), "SCA")
        .when(
            (t == "SECRET") | F.endswith(r, F.lit("-secret-key")) | (r == "gitleaks-secret"),
            "SecretScanner",
        )
        .when(t == "IAC", "IaCScanner")
        .when(
            starts("ai-") | has(r, "openai") | has(r, "claude") | has(r, "ollama") | has(r, "cursor"), ai
        )
        .when(has(r, "ai"), "AI")
        .otherwise("AST")
    )


def combined_confidence(detectors: Column) -> Column:
    """Percentage that at least one of the (sorted, distinct) detectors is right."""
    table = F.create_map(*[F.lit(x) for pair in DETECTOR_CONFIDENCE.items() for x in pair])
    missed = F.aggregate(
        detectors,
        F.lit(1.0),
        lambda acc, d: acc
        * (F.lit(1.0) - F.coalesce(F.try_element_at(table, d), F.lit(DETECTOR_CONFIDENCE_DEFAULT))),
    )
    return F.bround((F.lit(1.0) - missed) * 100, 0).cast("int")


def cvss_base(cwe: Column, own_score: Column | None = None) -> Column:
    """A finding's own numeric score, else the weakness table, else the default."""
    base = F.lit(CVSS_DEFAULT).cast("decimal(3,1)")
    table = F.when(F.lit(False), base)
    for name, score in CVSS_BASE.items():
        table = table.when(cwe == name, F.lit(score).cast("decimal(3,1)"))
    scored = table.otherwise(base)
    if own_score is None:
        return scored
    return F.coalesce(own_score.try_cast("decimal(3,1)"), scored)


def exploitability(cwe: Column) -> Column:
    return (
        F.when(cwe.isin(EXPLOIT_HIGH), "HIGH").when(cwe.isin(EXPLOIT_MEDIUM), "MEDIUM").otherwise("LOW")
    )


def risk_band(score: Column) -> Column:
    return (
        F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")
    )


def sarif_level(severity: Column) -> Column:
    sev = F.lower(F.coalesce(severity, F.lit("medium")))
    return F.when(sev.isin("critical", "high"), "error").when(sev == "low", "note").otherwise("warning")


def annotation_level(severity: Column) -> Column:
    return F.when(F.coalesce(severity, F.lit("")).isin("critical", "high"), "failure").otherwise("warning")


def cwe_help_uri(cwe: Column) -> Column:
    return F.when(
        F.contains(cwe, F.lit("-")),
        F.concat(
            F.lit("https://cwe.mitre.org/data/definitions/"), F.substring_index(cwe, "-", -1), F.lit(".html")
        ),
    ).otherwise("https://cwe.mitre.org")


def cwe_label(cwe: Column) -> Column:
    return F.upper(strip(cwe))


def cwe_number(cwe: Column) -> Column:
    """Number behind the last dash of a CWE id, NULL if it is not one."""
    label = cwe_label(cwe)
    digits = F.substring_index(label, "-", -1)
    return F.when(F.startswith(label, F.lit("CWE-")) & digits.rlike("^[0-9]+$"), digits.try_cast("int"))


def normalize_code(sink: Column, line: Column) -> Column:
    """A line without comments and blanks in lower case; 'line-N' if nothing is left."""
    code = F.regexp_replace(F.regexp_replace(sink, "#.*$", ""), "//.*$", "")
    bare = F.lower(F.regexp_replace(code, WHITESPACE_CLASS, ""))
    empty = F.concat(F.lit("line-"), F.coalesce(line.cast("string"), F.lit("None")))
    return F.when(bare == "", empty).otherwise(bare)


def fingerprint(repo: Column, shown_file: Column, cwe: Column, sink: Column, line: Column) -> Column:
    """Identity of a finding that survives moving the line."""
    parts = [repo, shown_file, cwe, sink, normalize_code(sink, line)]
    return F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def purl_type(file: Column) -> Column:
    name = F.lower(file)

    def any_of(*marks: str) -> Column:
        found = F.contains(name, F.lit(marks[0]))
        for m in marks[1:]:
            found = found | F.contains(name, F.lit(m))
        return found

    return (
        F.when(any_of("requirements.txt", "poetry.lock", "pipfile.lock"), "pypi")
        .when(any_of("package-lock.json", "yarn.lock", "pnpm-lock.yaml"), "npm")
        .when(any_of("pom.xml", "build.gradle"), "maven")
        .when(any_of("go.mod"), "golang")
        .when(any_of("cargo.lock"), "cargo")
        .when(any_of("gemfile.lock"), "gem")
        .when(any_of("composer.lock"), "composer")
        .otherwise("generic")
    )


def purl(file: Column, name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:"), purl_type(file), F.lit("/"), name, F.lit("@"), version)


def spdx_id(name: Column, version: Column) -> Column:
    return F.translate(F.concat(F.lit("SPDXRef-Package-"), name, F.lit("-"), version), "@/_", "---")
