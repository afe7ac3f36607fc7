"""Declared schemas. Nothing in the package infers a schema from data."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILES = "repo STRING, path STRING, size BIGINT, content STRING"

# One row per reported issue. Columns that a scanner does not fill are NULL.
FINDING_COLUMNS = {
    "repo": "string",
    "file": "string",
    "line": "int",
    "rule": "string",
    "cwe": "string",
    "severity": "string",
    "description": "string",
    "type": "string",
    "provider": "string",
    "secret": "string",
    "package": "string",
    "installed": "string",
    "affected": "string",
    "cve": "string",
    "fix": "string",
    "rule_remediation": "string",
    "sink": "string",
    "ord": "struct<scanner:int,path:string,line:int,rule:array<bigint>>",
}

DEPENDENCY = "repo STRING, file STRING, line INT, package STRING, version STRING, pos BIGINT"

POLICY = (
    "repo STRING, file_name STRING, parsed BOOLEAN, fail_on ARRAY<STRING>, "
    "scanners MAP<STRING,BOOLEAN>, thresholds ARRAY<STRUCT<sev:STRING,limit:INT>>, "
    "sandbox STRUCT<network:BOOLEAN,timeout:INT,memory:STRING,cpu:INT>"
)


def finding_order(scanner: int, path: Column, line: Column, *rule: Column) -> Column:
    """Sort key of a finding: the order in which one repository's scan would append it.

    ``rule`` are the positions within a line or report, outermost first.
    """
    return F.struct(
        F.lit(scanner).cast("int").alias("scanner"),
        path.alias("path"),
        line.cast("int").alias("line"),
        F.array(*[r.cast("bigint") for r in rule]).alias("rule"),
    )


def conform_findings(df: DataFrame) -> DataFrame:
    """Give any scanner's rows the full finding schema."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)).alias(name)
            for name, kind in FINDING_COLUMNS.items()
        ]
    )
