import glob
import json
import os

from pyspark.sql import functions as F

from auditlake.exports import report, review, sarif, sbom
from auditlake.exports.documents import write_documents
from auditlake.rules.templates import templates
from auditlake.sources import reports


def read_documents(path):
    out = {}
    for folder in glob.glob(f"{path}/repo=*"):
        text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{folder}/part-*")))
        out[folder.rsplit("=", 1)[1]] = json.loads(text)
    return out


def deps(spark):
    rows = [
        ("r", "requirements.txt", 1, "requests", "2.28.0", 0), ("r", "a/package-lock.json", 1, "lodash", "4.17.15", 0),
        ("r", "pom.xml", 1, "log4j_core", "2.14.1", 0), ("r", "z/pom.xml", 1, "requests", "2.28.0", 0), ("r", "go.mod", 1, "", "x", 0),
        ("s", "go.mod", 4, "q\"uote", "1", 0),
    ]
    return spark.createDataFrame(rows, "repo string, file string, line int, package string, version string, pos int")


def repos(spark):
    return spark.createDataFrame([("r",), ("s",), ("empty",)], "repo string")


def test_cyclonedx(spark, tmp_path):
    write_documents(sbom.cyclonedx_export(deps(spark), repos(spark), "2024-01-01T00:00:00Z"), str(tmp_path / "c"))
    docs = read_documents(tmp_path / "c")
    assert docs["r"]["bomFormat"] == "CycloneDX" and docs["r"]["specVersion"] == "1.5"
    assert docs["r"]["metadata"]["component"]["name"] == "r" and docs["empty"]["components"] == []
    purls = {c["purl"] for c in docs["r"]["components"]}
    assert purls == {"pkg:pypi/requests@2.28.0", "pkg:npm/lodash@4.17.15", "pkg:maven/log4j_core@2.14.1"}
    assert docs["s"]["components"][0]["name"] == 'q"uote'


def test_spdx(spark, tmp_path):
    write_documents(sbom.spdx_export(deps(spark), repos(spark), "2024-01-01T00:00:00Z"), str(tmp_path / "s"))
    doc = read_documents(tmp_path / "s")["r"]
    assert doc["spdxVersion"] == "SPDX-2.3" and len(doc["packages"]) == 3 == len(doc["relationships"])
    ids = {p["SPDXID"] for p in doc["packages"]}
    assert "SPDXRef-Package-log4j-core-2.14.1" in ids
    assert {r["relatedSpdxElement"] for r in doc["relationships"]} == ids


def findings(spark, n=1):
    rows = [("r", "app/auth.py", 87, "CWE-89", "SQL Injection", "text", "critical", "found \"it\"", "ast-sql", 0)]
    rows += [("r", f"f{i}", None, "CWE-79", None, None, "low", "d", "ast-x", i) for i in range(1, n)]
    schema = "repo string, file string, line int, cwe string, cwe_title string, cwe_description string, severity string, description string, rule string, ord int"
    return spark.createDataFrame(rows, schema)


def test_sarif(spark, tmp_path):
    write_documents(sarif.sarif_export(findings(spark, 500).repartition(4), repos(spark), "tool", "9"), str(tmp_path / "f"))
    docs = read_documents(tmp_path / "f")
    run = docs["r"]["runs"][0]
    assert docs["r"]["version"] == "2.1.0" and run["tool"]["driver"]["name"] == "tool"
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["ast-sql", "ast-x"]
    rule = run["tool"]["driver"]["rules"][0]
    assert rule["name"] == "ast_sql" and rule["shortDescription"]["text"] == "CWE-89: SQL Injection"
    assert len(run["results"]) == 500 and docs["empty"]["runs"][0]["results"] == []
    first = run["results"][0]
    assert first["ruleId"] == "ast-sql" and first["level"] == "error" and first["message"]["text"] == 'found "it"'
    place = first["locations"][0]["physicalLocation"]
    assert place["artifactLocation"]["uri"] == "r/app/auth.py" and place["region"] == {"startLine": 87, "endLine": 87}
    assert [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"][1:3]] == [1, 1]


def test_equal_and_tied_elements_keep_the_document_valid(spark, tmp_path):
    rows = findings(spark, 40).withColumn("ord", F.lit(5))
    rows = rows.unionByName(rows).unionByName(findings(spark))
    rows = rows.unionByName(findings(spark))
    write_documents(sarif.sarif_export(rows, repos(spark)), str(tmp_path / "t"))
    results = read_documents(tmp_path / "t")["r"]["runs"][0]["results"]
    assert len(results) == 82 and [r["ruleId"] for r in results[:2]] == ["ast-sql", "ast-sql"]


def test_report(spark, tmp_path):
    summary = spark.createDataFrame([("r", 2, "high")], "repo string, finding_count int, risk_level string")
    report.report_export(findings(spark, 2), summary, str(tmp_path / "j"))
    doc = read_documents(tmp_path / "j")["r"]
    assert doc["summary"] == {"finding_count": 2, "risk_level": "high"} and doc["source_path"] == "r"
    assert [f["file"] for f in doc["findings"]] == ["r/app/auth.py", "r/f1"]


def test_reviews(spark):
    body = '{"action":"opened","number":101,"repository":{"full_name":"r"},"pull_request":{"head":{"sha":"98765","ref":"b"}}}'
    rows = [(1, 1, body), (2, 2, body.replace("101", "102")), (3, 3, '{"number":1}'), (4, 4, "nope"), (5, 5, '{"pull_request":{}}'),
            (6, 6, '{"pull_request":{"head":{}}}')]
    bodies = spark.createDataFrame(rows, "ord int, ts int, body string")
    events = reports.ingest_pr_event(bodies)
    assert {(e.pr_number, e.repo, e.commit_sha, e.branch) for e in events.collect()} == {
        (101, "r", "98765", "b"), (102, "r", "98765", "b"), (1, "unknown/repo", "unknown-sha", "main"),
    }
    assert reports.parse_pr_events(bodies).filter("status = 'ignored'").count() == 2
    verdicts = spark.createDataFrame([("r", 0, 0, 1, 2, "SECURITY GATE FAILED")], "repo string, critical long, high long, medium long, low long, gate_status string")
    runs = {r.pr_number: r for r in review.pr_check_run(events, verdicts).collect()}
    assert runs[101].conclusion == "failure" and runs[101].summary == "0 Critical, 0 High, 1 Medium, 2 Low findings detected."
    assert runs[1].conclusion == "success" and runs[1].title == "Security Gate Passed"
    scanned = review.pr_scan_join(events, findings(spark))
    (note,) = review.pr_annotations(scanned, templates(spark)).collect()
    sent = {r.pr_number: r for r in review.pr_delivery(review.pr_annotations(scanned, templates(spark)), review.pr_targets(events)).collect()}
    assert sorted(sent) == [101, 102] and sent[101].commit_sha == "98765" and sent[102].title == note.title
    assert note.title == "CWE-89: ast-sql" and note.annotation_level == "failure"
    assert "parameterized queries" in note.message and note.path == "r/app/auth.py"
    (comment,) = review.pr_comments(scanned, templates(spark)).collect()
    assert comment.body.startswith("### ") and "CWE-89" in comment.body


def test_elements_of_several_parts_come_from_one_scan(spark, tmp_path):
    findings(spark, 300).repartition(4).write.parquet(str(tmp_path / "findings"))
    rows = spark.read.parquet(str(tmp_path / "findings"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = sarif.sarif_export(rows, repos(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_elements_without_order_keep_the_document_valid(spark, tmp_path):
    rows = findings(spark, 3).withColumn("ord", F.lit(None).cast("int"))
    write_documents(sarif.sarif_export(rows, repos(spark)), str(tmp_path / "n"))
    assert len(read_documents(tmp_path / "n")["r"]["runs"][0]["results"]) == 3
