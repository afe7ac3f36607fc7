"""Sources, streams, the whole audit, hot keys, and the shape of plans."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake.exports.report import report_export
from auditlake import schemas
from auditlake.operators import context, corpus, findings, iac, secrets
from auditlake.operators.history import latest_scan
from auditlake.plans import audit
from auditlake.operators.sca import sca_match
from auditlake.operators.scoring import gate, severity_counts
from auditlake.rules.vuln_db import vuln_db
from auditlake.rules.weaknesses import cwe_dim, guidance
from auditlake.schemas import FILES
from auditlake.skew import SALTS, lookup_join
from auditlake.sources import reports
from auditlake.sources.files import corpus_load, documents_as_files
from auditlake.streaming import latest, scan
from tests.test_exports import read_documents
from workload import queries as Q

KEY = "sk-abcdef1234567890abcdef1234567890abcd"


def test_directories_with_hidden_files(spark, tmp_path):
    for name, raw in {
        "a/.env": b"TOKEN=Abcdefgh1234567890xyz", ".gitlab-ci.yml": b"privileged: true", "_x/y.py": b"ok\xff", "big.py": b"x" * 200,
    }.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(raw)
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo string, root string")
    files = corpus_load(roots, max_bytes=100)
    got = {r.path: r for r in files.collect()}
    assert set(got) == {"a/.env", ".gitlab-ci.yml", "_x/y.py"} and got["_x/y.py"].content == "ok" and got["_x/y.py"].size == 3
    assert [r.file for r in secrets.secret_scan(files).collect()] == ["a/.env"]
    assert [r.rule for r in iac.iac_scan(files).collect()] == ["gitlab-unsafe-runner"]


def test_audit_of_a_small_repository(spark, tmp_path):
    files = spark.createDataFrame(
        [
            ("r", "app.py", 10, f"import requests\nKEY = '{KEY}'\n"), ("r", "Dockerfile", 10, "FROM a\nEXPOSE 80\n"),
            ("r", "requirements.txt", 10, "requests==2.0\nlodash==1.0\n"), ("s", "a.py", 10, "x = 1\n"),
        ],
        FILES,
    )
    result = audit.run_audit(files, vuln_db(spark), cwe_dim(spark), guidance(spark), out=str(tmp_path / "audit"))
    got = {(f.rule, f.file, f.line): f for f in result.scored.collect()}
    assert set(got) == {
        ("openai-secret-key", "app.py", 2), ("docker-run-as-root", "Dockerfile", 1),
        ("sca-requests", "requirements.txt", 1), ("sca-lodash", "requirements.txt", 2),
    }
    assert {f.internet_exposed for f in got.values()} == {"YES"}
    assert got["sca-requests", "requirements.txt", 1].reachable == "YES"
    assert got["sca-lodash", "requirements.txt", 2].reachable == "NO"
    assert got["sca-lodash", "requirements.txt", 2].sink == "lodash==1.0"
    key = got["openai-secret-key", "app.py", 2]
    assert (float(key.risk_score), key.severity, key.sink) == (8.8, "high", f"KEY = '{KEY}'")
    verdicts = {v.repo: v for v in result.verdicts.collect()}
    assert verdicts["r"].gate_reasons == ["HIGH findings count (1) exceeds threshold (0)"] and verdicts["s"].gate_status == "PASS"
    summary = {x.repo: x for x in result.summary.collect()}
    assert summary["r"].finding_count == 4 and summary["s"].risk_level == "low"

    report_export(result.scored, result.summary, str(tmp_path / "reports"), result.dependencies)
    docs = read_documents(tmp_path / "reports")
    assert len(docs["r"]["findings"]) == 4 and docs["s"]["findings"] == [] == docs["s"]["dependencies"]
    assert docs["r"]["dependencies"][0] == {"package": "requests", "version": "2.0", "file": "r/requirements.txt"}
    assert docs["r"]["summary"]["gate_status"] == "SECURITY GATE FAILED"


def test_scan_pass_equals_the_single_scanners(spark, small):
    files = Q.load(spark, small, "token_files").unionByName(Q.load(spark, small, "docker_files"))
    shown = ["repo", "file", "line", "rule", "severity", "secret", "sink", "rule_remediation"]
    one = audit.line_findings(audit.scan_pass(files)).select(*shown)
    many = secrets.secret_scan(files).unionByName(iac.iac_scan(files)).select(*shown)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_stream_in_three_batches_equals_batch(spark, small, tmp_path):
    files = Q.load(spark, small, "token_files").unionByName(Q.load(spark, small, "docker_files"))
    source = str(tmp_path / "in")
    for i in range(3):
        files.filter(F.pmod(F.xxhash64("path"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    scan.start_stream_scan(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = audit.line_findings(spark.read.parquet(out)).select("repo", "file", "line", "rule", "secret")
    want = audit.line_findings(audit.scan_pass(files)).select("repo", "file", "line", "rule", "secret")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

    policies = spark.createDataFrame([], "repo string, fail_on array<string>, thresholds array<struct<sev:string,limit:int>>")
    scan.start_stream_gate(stream, policies, str(tmp_path / "gate"), str(tmp_path / "cp2")).awaitTermination()
    verdicts = scan.current_verdicts(spark.read.parquet(str(tmp_path / "gate/verdicts")))
    batch = gate(severity_counts(scan.score_evidence(scan.stream_scan(files))), policies)
    cols = ["repo", "critical", "high", "medium", "low", "gate_status"]
    assert verdicts.select(*cols).exceptAll(batch.select(*cols)).count() == 0 and verdicts.count() == batch.count()


def test_stream_gate_takes_the_newest_version_of_a_file(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "gate")
    secret, clean = f'api_key = "{KEY}"\n', "x = 1\n"
    batches = [
        [("a", "x.py", secret), ("b", "y.py", secret), ("c", "z.py", clean)],
        [("a", "other.py", secret), ("b", "requirements.txt", "django==2.0\n"), ("d", "requirements.txt", "django==2.0\n")],
        [("a", "x.py", clean), ("a", "other.py", clean), ("b", "y.py", clean), ("d", "requirements.txt", "django==9.0\n")],
    ]
    for rows in batches:
        files = spark.createDataFrame([(r, p, len(t), t) for r, p, t in rows], FILES)
        files.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(source)
    policies = spark.createDataFrame([], "repo string, fail_on array<string>, thresholds array<struct<sev:string,limit:int>>")
    scan.start_stream_gate(stream, policies, out, str(tmp_path / "cp"), vuln_db(spark)).awaitTermination()

    found = {}
    for r in spark.read.parquet(f"{out}/verdicts").collect():
        found[r.batch, r.repo] = r.critical + r.high + r.medium + r.low
    assert found == {(0, "a"): 1, (0, "b"): 1, (0, "c"): 0, (1, "a"): 2, (1, "b"): 2, (1, "d"): 1, (2, "a"): 0, (2, "b"): 1, (2, "d"): 0}
    last = {r.repo: r.critical + r.high + r.medium + r.low for r in scan.current_verdicts(spark.read.parquet(f"{out}/verdicts")).collect()}
    assert last == {"a": 0, "b": 1, "c": 0, "d": 0}


def test_stream_gate_folds_signed_counts(spark, tmp_path):
    """Mended, deleted and returning files over many batches, with snapshots; a batch that comes again changes nothing."""
    source, out = str(tmp_path / "in"), str(tmp_path / "gate")
    secret, clean, shown = f'api_key = "{KEY}"\n', "x = 1\n", f'api_key = "{KEY}"\nimport flask\n'
    old = "django==2.0\n"
    batches = [
        [("a", "x.py", secret, False), ("a", "y.py", secret, None), ("b", "requirements.txt", old, False)],
        [("a", "x.py", None, True), ("b", "never.py", None, True)],
        [("a", "web.py", shown, False), ("b", "requirements.txt", None, True)],
        [("a", "x.py", secret, False), ("a", "x.py", None, True), ("b", "requirements.txt", old, False)],
        [("a", "web.py", None, True), ("a", "y.py", clean, False)],
        [("a", "x.py", None, True), ("b", "requirements.txt", "django==9.0\n", False)],
    ]
    schema = "repo string, path string, size long, content string, deleted boolean"
    for rows in batches:
        files = spark.createDataFrame([(r, p, len(t or ""), t, d) for r, p, t, d in rows], schema)
        files.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    policies = spark.createDataFrame([], "repo string, fail_on array<string>, thresholds array<struct<sev:string,limit:int>>")

    def total():
        return {(r.batch, r.repo): r.critical + r.high + r.medium + r.low for r in spark.read.parquet(f"{out}/verdicts").collect()}

    scan.start_stream_gate(stream, policies, out, str(tmp_path / "cp"), vuln_db(spark), compact=3).awaitTermination()
    want = {
        (0, "a"): 2, (0, "b"): 1, (1, "a"): 1, (1, "b"): 1, (2, "a"): 2, (2, "b"): 0, (3, "a"): 3, (3, "b"): 1,
        (4, "a"): 1, (5, "a"): 0, (5, "b"): 0,
    }
    assert total() == want
    # The exposure counts as long as a file shows it: batch 2 and 3 are rated as exposed, batch 4 is not.
    exposed = {r.batch: (r.critical, r.high, r.medium, r.low) for r in spark.read.parquet(f"{out}/verdicts").filter("repo = 'a'").collect()}
    now = spark.createDataFrame([("a", "y.py", 1, secret), ("a", "web.py", 1, shown)], FILES)
    (rated,) = severity_counts(scan.score_evidence(scan.stream_scan(now))).collect()
    assert exposed[2] == (rated.critical, rated.high, rated.medium, rated.low) and exposed[1] == exposed[4] != (1, 0, 0, 0)
    # Two snapshots were made; of the changes only those of the version before are still there.
    kept = sorted(f.name for f in (tmp_path / "gate").iterdir() if f.is_dir() and f.name.startswith(("changes", "snapshot")))
    assert len(kept) <= 5 and "snapshot-5" in kept and "changes-0" not in kept
    assert not list((tmp_path / "gate/snapshot-5/files").glob("bucket=*"))  # all came to nothing

    pointer = (tmp_path / "gate" / latest.POINTER).read_text()
    scan.start_stream_gate(stream, policies, out, str(tmp_path / "cp2"), vuln_db(spark), compact=3).awaitTermination()
    assert total() == want and (tmp_path / "gate" / latest.POINTER).read_text() == pointer


def test_stream_latest_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "repo string, ord long, ts timestamp, status string"
    for i in range(3):
        rows = [("a", i, f"2024-01-0{3 - i} 00:00:00", f"s{i}"), ("b", 10 + i, f"2024-01-0{i + 1} 00:00:00", f"t{i}")]
        df = spark.createDataFrame(rows, "repo string, ord long, ts string, status string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    latest.start_stream_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.repo, r.status) for r in latest.current_latest(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", "s0"), ("b", "t2")}


def test_stream_latest_is_compacted(spark, tmp_path):
    """After fifty batches a read opens one snapshot; a batch that comes again changes nothing."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "repo string, ord long, ts timestamp, status string"
    rows = spark.range(50).selectExpr(
        "concat('r', id % 7) repo", "id ord", "timestamp_seconds(1000 + (id * 37) % 50) ts", "cast(id as string) status"
    )
    rows.repartitionByRange(50, "ord").write.parquet(source)
    files = len([f for f in (tmp_path / "in").iterdir() if f.name.startswith("part")])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    latest.start_stream_latest(stream, out, str(tmp_path / "cp"), compact=files // 5).awaitTermination()
    expected = {tuple(r) for r in latest_scan(spark.read.parquet(source)).collect()}
    current = latest.current_latest(spark, out)
    assert {tuple(r) for r in current.collect()} == expected
    pointer = (tmp_path / "out" / latest.POINTER).read_text()
    if files % (files // 5) == 0:
        assert len({f.rsplit("/", 2)[1] for f in current.inputFiles()}) == 1
    # Changes and snapshots of versions before the last one are gone.
    assert len([f for f in (tmp_path / "out").iterdir() if f.is_dir()]) <= files // 5 + 2
    # Without the checkpoint every batch comes again.
    latest.start_stream_latest(stream, out, str(tmp_path / "cp2"), compact=files // 5).awaitTermination()
    assert (tmp_path / "out" / latest.POINTER).read_text() == pointer
    assert {tuple(r) for r in latest.current_latest(spark, out).collect()} == expected
    with pytest.raises(ValueError):
        latest.current_latest(spark, str(tmp_path / "nothing"))


def test_hot_repository_is_spread(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 50).cast("string"))).alias("repo"), "id"
    )
    lookup = rows.select("repo").distinct().withColumn("v", F.length("repo"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(rows, lookup, ["repo"], ["id"])
        assert joined.count() == 20000 and joined.filter("v IS NULL").count() == 0
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        largest = salted.filter("repo = 'hot'").groupBy("repo", "_salt").count().agg(F.max("count")).first()[0]
        assert largest < 20000 * 2 / 3 / SALTS * 1.5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_scanners_need_no_shuffle(spark, small):
    files = spark.read.parquet(f"{small}/documents.parquet").transform(documents_as_files)
    for df in (secrets.secret_scan(files), iac.iac_scan(files), audit.scan_pass(files)):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Python" not in plan


def test_reductions_happen_before_the_shuffle(spark, small):
    raw = Q.load(spark, small, "findings")
    plan = plan_of(findings.dedup_findings(raw))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_min_by" in plan
    assert "WindowGroupLimit" in plan_of(corpus.review_candidates(Q.load(spark, small, "mixed_files"), 5))
    files = Q.load(spark, small, "code_files")
    exposed = plan_of(context.exposure(files))
    assert "partial_bool_or" in exposed or "partial_max" in exposed


def test_column_pruning_reaches_the_scan(spark, small):
    files = spark.read.parquet(f"{small}/documents.parquet").transform(documents_as_files)
    plan = plan_of(corpus.prune_ignored_dirs(files).select("path"))
    assert "text" not in plan.split("ReadSchema")[1]


def test_audit_of_policies_and_reports(spark, tmp_path):
    files = spark.createDataFrame(
        [("off", "app/Dockerfile", 9, "FROM x"), ("off", "requirements.txt", 9, "django==1.0"), ("on", "requirements.txt", 9, "django==1.0"),
         ("on", "big.py", 11 << 20, "api_key = 'Ab3dEf6hIj9kLm2nOp5q'")], "repo string, path string, size long, content string"
    )
    everything = {s: False for s in ("sast", "secrets", "dependencies", "iac", "ai_review")}
    policies = spark.createDataFrame([("off", ".security.yaml", True, None, everything, None, None)], schemas.POLICY)
    report = spark.createDataFrame([("only", json.dumps({"results": [{"source": {"path": "p"}, "packages": [
        {"package": {"name": "a", "version": "1"}, "vulnerabilities": [{"id": f"G{k}"} for k in range(3)]}] * 2}] * 25_000}))], "repo string, report string")
    found = reports.ingest_osv(report)
    assert found.count() == 150_000 and found.select("ord").distinct().count() == 150_000
    result = audit.run_audit(files, vuln_db(spark), cwe_dim(spark), guidance(spark), policies, [found], out=str(tmp_path / "audit"),
                             max_bytes=10 << 20, reported_dependencies=reports.ingest_osv_deps(report).limit(5))
    assert {r.repo for r in result.verdicts.collect()} == {"off", "on", "only"}
    assert result.raw.filter("repo = 'off'").count() == 0 and result.raw.filter("repo = 'on'").count() > 0
    assert {r.repo for r in result.dependencies.collect()} == {"on", "only"}
    assert [r.path for r in result.warnings.collect()] == ["big.py"]
    assert {r.repo: r.skipped_files for r in result.summary.collect()} == {"off": 0, "on": 1, "only": 0}


def in_parts(spark, tmp_path, name, rows):
    """A table of eight files, read in several parts."""
    path = tmp_path / f"{name}.parquet"
    rows.repartition(8).write.parquet(str(path))
    return spark.read.parquet(str(path)).rdd.getNumPartitions()


def test_a_stream_of_a_table_has_three_batches_of_many_files(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("event_id"))
    parts = in_parts(spark, tmp_path, "events", rows)
    written = tmp_path / "written"
    monkeypatch.setattr(Q, "fresh_path", lambda spark, label: str(written))
    stream = Q._stream(spark, str(tmp_path), "events")
    assert parts > 1 and len(list(written.glob("*.parquet"))) == 3 * parts
    batches = []
    run = stream.writeStream.foreachBatch(lambda batch, k: batches.append({r[0] for r in batch.collect()}))
    run.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 3 and sorted(x for b in batches for x in b) == list(range(400))


def test_changes_of_the_gate_are_written_in_parts(spark, tmp_path, small, monkeypatch):
    parts = in_parts(spark, tmp_path, "documents", spark.read.parquet(f"{small}/documents.parquet"))
    seen, keep = [], Q.stream_scan_job.start_stream_gate

    def looked(*given, **named):
        seen.append(len(list((tmp_path / "changes").glob("*.parquet"))))
        return keep(*given, **named)

    monkeypatch.setattr(Q, "fresh_path", lambda spark, label: str(tmp_path / label))
    monkeypatch.setattr(Q, "_policies", lambda spark, d: spark.createDataFrame([], "repo string, fail_on array<string>, thresholds array<struct<sev:string,limit:int>>"))
    monkeypatch.setattr(Q.stream_scan_job, "start_stream_gate", looked)
    assert Q.stream_gate_changes(spark, str(tmp_path)).count() > 0
    assert parts > 1 and len(seen) == 3 and seen[0] >= parts


def test_buckets_follow_the_parts_of_the_table(spark, tmp_path, monkeypatch):
    rows = spark.range(80).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("import requests").alias("text"), F.lit(15).alias("n_chars"))
    parts = in_parts(spark, tmp_path, "documents", rows)
    asked, keep = [], Q.store_corpus
    monkeypatch.setattr(Q, "store_corpus", lambda files, buckets: asked.append(buckets) or keep(files, buckets))
    assert Q._in_buckets(spark, str(tmp_path), "import_files", "documents").files().count() == 80
    assert parts > 2 and asked == [4 * parts]


def test_manifests_of_one_part_are_read_in_several(spark, small):
    found = Q.QUERIES["deps_go_mod"](spark, small)
    assert len(found.inputFiles()) > 1 and found.count() > 0


def test_matched_versions_are_not_repeated_per_salt(spark):
    deps = spark.createDataFrame([("r", "f", 1, "django", "1.0", 1)], "repo string, file string, line int, package string, version string, pos int")
    table = spark.createDataFrame([("django", f"=={k % 2}.0", f"c{k}", "low", "") for k in range(20)], "package string, affected string, cve string, severity string, fix string")
    hits = sca_match(deps, table)
    assert hits.count() == 10 and "_salt" not in plan_of(hits) and "Broadcast" not in plan_of(hits)
