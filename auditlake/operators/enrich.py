"""Texts for findings: weakness names, advice and remediation templates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.labels import cwe_label, cwe_number
from auditlake.rules import templates as t
from auditlake.rules import weaknesses as w


def cwe_enrich(findings: DataFrame, cwe_dim: DataFrame) -> DataFrame:
    """Add cwe_title and cwe_description; unknown ids get the fixed replacement texts."""
    label, number = cwe_label(F.col("cwe")), cwe_number(F.col("cwe"))
    dim = cwe_dim.select(
        F.col("cwe_number").alias("_number"),
        F.col("title").alias("_title"),
        F.col("description").alias("_description"),
        F.lit(True).alias("_known"),
    )
    joined = findings.withColumn("_number", number).join(dim, "_number", "left")
    is_id = F.startswith(label, F.lit("CWE-"))
    known = F.coalesce(F.col("_known"), F.lit(False))
    own_title = F.coalesce(
        F.nullif("_title", F.lit("")), F.concat(F.lit("CWE-"), F.col("_number").cast("string"), F.lit(" Definition"))
    )
    own_text = F.coalesce(F.nullif("_description", F.lit("")), F.lit(w.NO_DESCRIPTION))
    return joined.withColumns(
        {
            "cwe_title": F.when(known, own_title)
            .when(is_id, F.concat(label, F.lit(" Vulnerability")))
            .otherwise(label),
            "cwe_description": F.when(known, own_text).when(is_id, w.NOT_FOUND).otherwise(w.UNKNOWN_ID),
        }
    ).drop("_number", "_title", "_description", "_known")


def remediation_join(findings: DataFrame, guidance: DataFrame) -> DataFrame:
    """Add the advice for the weakness (the default advice where the table has none)."""
    rows = guidance.select(F.col("cwe").alias("_cwe"), "remediation")
    keyed = findings.drop("remediation").withColumn("_cwe", cwe_label(F.col("cwe")))
    return keyed.join(rows, "_cwe", "left").withColumn(
        "remediation", F.coalesce("remediation", F.lit(w.DEFAULT_GUIDANCE))
    ).drop("_cwe")


def _fallback(cwe: Column, sink: Column) -> Column:
    """The generated template for a weakness without one, as a struct like a template row."""
    given = F.nullif(sink, F.lit(""))

    def text(pattern: str) -> Column:
        return F.replace(F.lit(pattern), F.lit("{cwe}"), cwe)

    f = t.FALLBACK
    steps = [
        F.struct(
            F.lit(i + 1).alias("step"),
            F.lit(t.STEP_TYPES[i]).alias("type"),
            F.lit(label).alias("label"),
            F.coalesce(given, F.lit(code)).alias("code"),
            text(description).alias("description"),
        )
        for i, (label, code, description) in enumerate(f["flow"])
    ]
    return F.struct(
        text(f["why"]).alias("why"),
        F.lit(f["source"]).alias("source"),
        F.coalesce(given, F.lit(f["sink"])).alias("sink"),
        F.lit(f["exploit"]).alias("exploit"),
        text(f["cwe"]).alias("cwe"),
        F.lit(f["fix_desc"]).alias("fix_desc"),
        F.coalesce(given, F.lit(f["original_code"])).alias("original_code"),
        F.replace(
            F.lit(f["secure_code"]), F.lit("{code}"), F.coalesce(given, F.lit(f["secure_code_empty"]))
        ).alias("secure_code"),
        F.array(*steps).alias("data_flow"),
    )


def template_join(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """Add ``details``: the weakness's remediation template, or one generated from the line."""
    parts = [c for c in templates.columns if c != "cwe_id"]
    rows = templates.select(F.col("cwe_id").alias("cwe"), F.struct(*parts).alias("_template"))
    sink = F.coalesce(F.col("sink"), F.lit(""))
    details = F.coalesce(F.col("_template"), _fallback(F.col("cwe"), sink))
    filled = F.coalesce(
        F.nullif(details["original_code"], F.lit("")), F.nullif(sink, F.lit("")), F.lit(t.EMPTY_ORIGINAL_CODE)
    )
    return findings.join(rows, "cwe", "left").withColumn(
        "details", details.withField("original_code", filled)
    ).drop("_template")


def advice_join(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """Add ``advice``, the short fix text used in review annotations."""
    rows = templates.select(F.col("cwe_id").alias("cwe"), F.col("fix_desc").alias("advice"))
    return findings.join(rows, "cwe", "left").withColumn(
        "advice", F.coalesce("advice", F.lit(t.DEFAULT_ADVICE))
    )
