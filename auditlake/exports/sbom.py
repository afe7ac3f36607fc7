"""Dependency inventories: CycloneDX 1.5 and SPDX 2.3."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.exports.documents import element_lines, fixed_line, tagged
from auditlake.functions.labels import purl, spdx_id

NOASSERTION = "NOASSERTION"


def sbom_components(deps: DataFrame) -> DataFrame:
    """Distinct (package, version) per repository; the first one seen decides the file.

    'First seen' is by file, line and place in the line.
    """
    order = F.struct("file", "line", "pos")
    return (
        deps.filter("package <> '' AND version <> ''")
        .groupBy("repo", "package", "version")
        .agg(F.min(order).alias("ord"))
        .select(
            "repo",
            "package",
            "version",
            F.col("ord.file").alias("file"),
            purl(F.col("ord.file"), F.col("package"), F.col("version")).alias("purl"),
            F.struct("ord.file", "ord.line", "ord.pos", "package", "version").alias("ord"),
        )
    )


def _serial(repo: Column, stamp: Column) -> Column:
    """A repeatable UUID-shaped id of a document."""
    h = F.sha2(F.concat_ws("|", repo, stamp), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def cyclonedx_export(
    deps: DataFrame, repos: DataFrame, timestamp: str, tool_name: str = "auditlake", tool_version: str = "0.1.0"
) -> DataFrame:
    """One document per repository as lines. Time is given, so a rerun gives the same text."""
    components = sbom_components(deps)
    ord_type = dict(components.dtypes)["ord"]
    element = F.struct(
        F.lit("library").alias("type"), F.col("package").alias("name"), "version", "purl"
    )
    serial = _serial(F.col("repo"), F.lit(timestamp))
    opening = F.concat(
        F.lit('{"bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":"urn:uuid:'),
        serial,
        F.lit(f'","version":1,"metadata":{{"timestamp":"{timestamp}","tools":{{"components":[{{'),
        F.lit(f'"type":"application","name":"{tool_name}","version":"{tool_version}"}}]}},'),
        F.lit('"component":{"type":"application","name":'),
        _quoted(F.col("repo")),
        F.lit('}},"components":['),
    )
    parts = [
        fixed_line(repos, 0, opening, ord_type),
        element_lines(components, tagged(1, element)),
        fixed_line(repos, 2, F.lit("]}"), ord_type),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def spdx_packages(deps: DataFrame) -> DataFrame:
    return sbom_components(deps).withColumn("spdx_id", spdx_id(F.col("package"), F.col("version")))


def spdx_relationships(packages: DataFrame) -> DataFrame:
    return packages.select(
        "*",
        F.lit("SPDXRef-DOCUMENT").alias("spdx_element_id"),
        F.col("spdx_id").alias("related_spdx_element"),
        F.lit("DESCRIBES").alias("relationship_type"),
    )


def spdx_export(
    deps: DataFrame, repos: DataFrame, timestamp: str, tool_name: str = "auditlake", tool_version: str = "0.1.0"
) -> DataFrame:
    """One document per repository as lines."""
    packages = spdx_packages(deps)
    ord_type = dict(packages.dtypes)["ord"]
    none = F.lit(NOASSERTION)
    package = F.struct(
        F.col("package").alias("name"),
        F.col("spdx_id").alias("SPDXID"),
        F.col("version").alias("versionInfo"),
        none.alias("downloadLocation"),
        F.lit(False).alias("filesAnalyzed"),
        none.alias("licenseConcluded"),
        none.alias("licenseDeclared"),
        none.alias("copyrightText"),
        F.array(
            F.struct(
                F.lit("PACKAGE-MANAGER").alias("referenceCategory"),
                F.lit("purl").alias("referenceType"),
                F.col("purl").alias("referenceLocator"),
            )
        ).alias("externalRefs"),
    )
    relationship = F.struct(
        F.col("spdx_element_id").alias("spdxElementId"),
        F.col("related_spdx_element").alias("relatedSpdxElement"),
        F.col("relationship_type").alias("relationshipType"),
    )
    namespace = F.concat(
        F.lit("https://spdx.org/spdxdocs/"), F.col("repo"), F.lit("-"), _serial(F.col("repo"), F.lit(timestamp))
    )
    opening = F.concat(
        F.lit('{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":'),
        _quoted(F.col("repo")),
        F.lit(',"documentNamespace":'),
        _quoted(namespace),
        F.lit(f',"creationInfo":{{"created":"{timestamp}","creators":["Tool: {tool_name}-{tool_version}"]}},'),
        F.lit('"packages":['),
    )
    parts = [
        fixed_line(repos, 0, opening, ord_type),
        element_lines(spdx_relationships(packages), tagged(1, package), tagged(3, relationship)),
        fixed_line(repos, 2, F.lit('],"relationships":['), ord_type),
        fixed_line(repos, 4, F.lit("]}"), ord_type),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
