import random

from pyspark.sql import functions as F

from auditlake.operators import context, enrich, findings, history, patch, policy, scoring
from auditlake.rules.templates import TEMPLATES, templates
from auditlake.sources.catalog import read_weaknesses
from auditlake.rules.weaknesses import DEFAULT_GUIDANCE, cwe_dim, guidance
from auditlake.schemas import FILES

RAW = "ord long, repo string, file string, line int, cwe string, rule string, severity string, description string"


def scored(spark, rows, exposed):
    raw = spark.createDataFrame(rows, RAW).withColumn("package", F.lit(None).cast("string"))
    unique = findings.dedup_findings(raw)
    flags = spark.createDataFrame([("r", exposed)], "repo string, internet_exposed boolean")
    return scoring.risk_score(scoring.add_exposure(unique.withColumn("reachable", F.lit("YES")), flags))


def test_three_detectors_on_one_place(spark):
    rows = [
        (1, "r", "users.py", 81, "CWE-89", "ast-shell-injection", "medium", "AST detected SQL Injection"),
        (2, "r", "users.py", 81, "CWE-89", "bandit-B608", "high", "Bandit detected SQL Injection"),
        (3, "r", "users.py", 81, "CWE-89", "ai-openai", "critical", "AI detected SQL Injection"),
    ]
    (f,) = scored(spark, rows, False).collect()
    assert f.detected_by == ["AI (OpenAI)", "AST", "Bandit"] and f.confidence == 98 and f.ord == 3
    assert (float(f.cvss), float(f.risk_score), f.severity, f.exploitability) == (9.8, 5.7, "medium", "MEDIUM")
    assert f.internet_exposed == "NO"


def test_exposed_single_finding(spark):
    (f,) = scored(spark, [(1, "r", "app.py", 10, "CWE-78", "ast-x", "medium", "d")], True).collect()
    assert (float(f.risk_score), f.severity, f.internet_exposed) == (5.8, "medium", "YES")


def test_representative_and_null_line(spark):
    rows = [
        (1, "r", "a", None, "CWE-79", "x", "low", "longest description"),
        (2, "r", "a", None, "CWE-79", "y", "high", "short"),
        (3, "r", "a", None, "CWE-79", "z", "HIGH", "other"),
        (4, "r", "a", 1, "CWE-79", "w", "odd", "d"),
    ]
    got = {r.line: r for r in findings.dedup_findings(spark.createDataFrame(rows, RAW)).collect()}
    assert got[None].rule == "y" and got[None].reports == 3 and got[1].rule == "w"


def policy_rows(spark, rows):
    schema = (
        "repo string, file_name string, parsed boolean, fail_on array<string>, scanners map<string,boolean>, "
        "thresholds array<struct<sev:string,limit:int>>, sandbox struct<network:boolean,timeout:int,memory:string,cpu:int>"
    )
    return spark.createDataFrame(rows, schema)


def test_policy_precedence_merge_and_plan(spark):
    rows = [
        ("r", "security.yml", True, ["high"], None, None, None),
        ("r", "security.yaml", True, ["low"], {"secrets": False, "extra": True}, [("low", 1), ("high", 2)], (None, 45, None, None)),
        ("r", ".security.yaml", False, ["never"], None, None, None),
    ]
    repos = spark.createDataFrame([("r",), ("s",)], "repo string")
    merged = policy.policy_merge(repos, policy_rows(spark, rows))
    got = {p.repo: p for p in merged.collect()}
    assert got["r"].fail_on == ["low"] and got["s"].fail_on == ["critical", "high"]
    assert [tuple(t) for t in got["r"].thresholds] == [("critical", 0), ("high", 2), ("low", 1)]
    assert got["r"].scanners["secrets"] is False and got["r"].scanners["extra"] and got["r"].scanners["sast"]
    assert tuple(got["r"].sandbox) == (False, 45, "4GB", 2)
    plan = {(p.repo, p.scanner) for p in policy.scanner_plan(merged, "local_only").collect()}
    assert plan == {(r, s) for r in "rs" for s in ["bandit", "codeql", "secrets", "sca", "iac"]} - {("r", "secrets")}
    assert {p.scanner for p in policy.scanner_plan(merged, "ast_only").filter("repo = 's'").collect()} == {"secrets", "sca", "iac"}


def test_gate_reasons_in_policy_order(spark):
    counts = spark.createDataFrame(
        [("r", 1, 3, 2, 2), ("s", 0, 0, 9, 9), ("t", 0, 1, 0, 0)], "repo string, critical long, high long, medium long, low long"
    )
    rows = [("r", "security.yaml", True, ["medium", "HIGH"], None, [("low", 1), ("high", 2)], None)]
    merged = policy.policy_merge(counts, policy_rows(spark, rows))
    got = {g.repo: g for g in scoring.gate(counts, merged).collect()}
    assert got["r"].gate_reasons == [
        "CRITICAL findings count (1) exceeds threshold (0)",
        "HIGH findings count (3) exceeds threshold (2)",
        "LOW findings count (2) exceeds threshold (1)",
        "Security policy fails on MEDIUM severity (2 found)",
    ]
    assert got["s"].gate_status == "PASS" and got["t"].gate_status == "SECURITY GATE FAILED"


def test_weakness_texts(spark):
    rows = spark.createDataFrame([("CWE-89",), ("CWE-424242",), ("odd",), (" cwe-78 ",), ("CWE-x",)], "cwe string")
    got = {r.cwe: (r.cwe_title, r.cwe_description) for r in enrich.cwe_enrich(rows, cwe_dim(spark)).collect()}
    assert got["CWE-89"][0] == "SQL Injection" and got["CWE-424242"][0] == "CWE-424242 Vulnerability"
    assert got["odd"] == ("ODD", "Unknown CWE identifier.") and got[" cwe-78 "][0] == "OS Command Injection"
    assert got["CWE-x"][0] == "CWE-X Vulnerability"
    advice = {r.cwe: r.remediation for r in enrich.remediation_join(rows, guidance(spark)).collect()}
    assert advice["odd"] == DEFAULT_GUIDANCE and "subprocess" in advice[" cwe-78 "]


def test_templates_have_all_parts(spark):
    rows = templates(spark).collect()
    assert len(rows) == 6 == len(TEMPLATES)
    for t in rows:
        assert all(t[c] for c in t.asDict()) and [s.type for s in t.data_flow] == ["SOURCE", "PROPAGATION", "SINK"]
    f = spark.createDataFrame([("CWE-78", "x"), ("CWE-1", "code()"), ("CWE-1", "")], "cwe string, sink string")
    got = enrich.template_join(f, templates(spark)).collect()
    texts = {(r.cwe, r.sink): r.details for r in got}
    assert texts["CWE-1", "code()"].secure_code == "# Secured replacement code\ncode()"
    assert texts["CWE-1", ""].secure_code.endswith("pass") and "subprocess" in texts["CWE-78", "x"].original_code


def test_weakness_catalog_in_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text(
        """<?xml version="1.0"?><Weakness_Catalog xmlns="urn:x" Version="1"><Weaknesses>
        <Weakness ID="79" Name="Page &amp; script" Status="Stable"><Description>One &lt;text&gt;</Description>
          <Related_Weaknesses><Related_Weakness CWE_ID="74"/></Related_Weaknesses></Weakness>
        <Weakness ID="20" Name="B"/><Weakness ID="20" Name="A"><Description>x</Description></Weakness>
        <Weakness Name="no number"/></Weaknesses>
        <Categories><Category ID="5" Name="no weakness"><Summary>s</Summary></Category></Categories></Weakness_Catalog>"""
    )
    got = {tuple(r) for r in read_weaknesses(spark, str(tmp_path)).collect()}
    assert got == {(79, "Page & script", "One <text>"), (20, "A", "x")}
    rows = spark.createDataFrame([("CWE-79",), ("CWE-5",), (None,)], "cwe string")
    titles = {r.cwe: r.cwe_title for r in enrich.cwe_enrich(rows, read_weaknesses(spark, str(tmp_path))).collect()}
    assert len(titles) == 3 and titles["CWE-79"] == "Page & script" and titles["CWE-5"] == "CWE-5 Vulnerability"
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/c.xml").write_text("<Weakness_Catalog><Weaknesses></Weaknesses></Weakness_Catalog>")
    assert read_weaknesses(spark, str(tmp_path / "empty")).count() == 0


def test_sink_of_missing_places(spark):
    files = spark.createDataFrame([("r", "a.py", 9, " one \r\ntwo")], FILES)
    rows = spark.createDataFrame(
        [(1, "r", "a.py", 1), (2, "r", "a.py", 2), (3, "r", "a.py", 3), (4, "r", "a.py", 0), (5, "r", "a.py", None), (6, "r", "x", 1)],
        "ord int, repo string, file string, line int",
    )
    got = {r.ord: r.sink for r in context.sink_lookup(rows, files).collect()}
    assert got == {1: "one", 2: "two", 3: "", 4: "", 5: "", 6: ""}


def test_only_findings_without_a_line_are_shuffled(spark, tmp_path):
    """Those that carry their line, and those that meet few mentions, stay where they are."""
    spark.createDataFrame([("r", "a.py", 9, "one\nimport x")], FILES).write.parquet(f"{tmp_path}/files")
    rows = [(k, "r", "a.py", k, "CWE-1104", "x" if k % 2 else "y", None if k < 5 else f"own {k}") for k in range(300)]
    schema = "ord int, repo string, file string, line int, cwe string, package string, sink string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/rows")
    files, found = spark.read.parquet(f"{tmp_path}/files"), spark.read.parquet(f"{tmp_path}/rows")
    located = context.sink_lookup(found, files)
    plan = located._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "Filter isnotnull(sink" in plan and located.columns == ["repo", "file", "line", "ord", "cwe", "package", "sink"]
    assert {r.ord: r.sink for r in located.collect()} == {0: "", 1: "one", 2: "import x", 3: "", 4: ""} | {k: f"own {k}" for k in range(5, 300)}
    marked = context.reachability(found, files)
    assert any("package-mentions" in f for f in marked.inputFiles())
    assert {r.ord: r.reachable for r in marked.collect()} == {k: "YES" if k % 2 else "NO" for k in range(300)}


def test_reachability_is_a_substring_test_in_code_of_the_same_repository(spark):
    files = spark.createDataFrame(
        [("r", "a.py", 1, "import MyLodashX"), ("r", "b.txt", 1, "django"), ("s", "node_modules/b.js", 1, "require('django')")], FILES
    )
    rows = [
        ("r", "f", 1, "CWE-1104", "lodash"), ("r", "f", 2, "CWE-1104", "Django"), ("s", "f", 3, "CWE-1104", "Django"),
        ("r", "f", 4, "CWE-1104", None), ("r", "f", 5, "CWE-79", "django"), ("t", "f", 6, "CWE-1104", "x"),
    ]
    df = spark.createDataFrame(rows, "repo string, file string, line int, cwe string, package string")
    got = {r.line: r.reachable for r in context.reachability(df, files).collect()}
    assert got == {1: "YES", 2: "NO", 3: "YES", 4: "YES", 5: "YES", 6: "NO"}


def test_many_names_are_looked_for_in_groups(spark):
    names = [f"pkg{i:04d}x" for i in range(1200)]
    rows = spark.createDataFrame([("r", n) for n in names], "repo string, package string")
    files = spark.createDataFrame([("r", f"f{i}.py", 1, " ".join(names[i::7][::2])) for i in range(7)], FILES)
    want = {n for i in range(7) for n in names[i::7][::2]}
    for limit in (context.BROADCAST_GROUPS, 0):
        assert {r.package for r in context.package_mentions(rows, files, limit).collect()} == want


def test_patches_of_one_file_follow_each_other(spark):
    files = spark.createDataFrame([("r", "a", 5, "x = 1\ny = 2\nx = 1"), ("r", "b", 1, "keep")], FILES)
    rows = [
        ("r", "a", 1, 2, "y", "y = 3"), ("r", "a", 2, None, " x = 1 ", " z "), ("r", "a", 3, 9, "missing", "q"),
        ("r", "a", 4, 3, "", "last\nline"), ("r", "b", 1, 1, "other", "q"), ("r", "nofile", 1, 1, "", "q"),
    ]
    patches = spark.createDataFrame(rows, "repo string, file string, ord int, line int, original_code string, new_code string")
    for per_round in (1000, 2, 1):
        changed, status = patch.patch_apply(files, patches, per_round)
        assert [(r.path, r.content) for r in changed.collect()] == [("a", "z\ny = 3\nlast\nline\n")]
        got = {(r.file, r.ord): r.status for r in status.collect()}
        assert got == {("a", 1): "line", ("a", 2): "text", ("a", 3): "failed", ("a", 4): "line", ("b", 1): "failed", ("nofile", 1): "failed"}


def _in_turn(content, rows):
    """Patches of one file one after the other."""
    statuses = []
    for _, line, original, new in sorted(rows, key=lambda r: r[0]):
        lines = content.splitlines()
        wanted = (original or "").strip()
        present = lines[line - 1].strip() if line and 1 <= line <= len(lines) else None
        if new is None:
            statuses.append("failed")
        elif present is not None and (not original or wanted in present or present in wanted):
            content = "\n".join([*lines[: line - 1], new, *lines[line:]]) + "\n"
            statuses.append("line")
        elif original and wanted in content:
            content = content.replace(wanted, new.strip())
            statuses.append("text")
        else:
            statuses.append("failed")
    return content, statuses


PATCHES = "repo string, file string, ord int, line int, original_code string, new_code string"


def test_patches_equal_applying_them_in_turn(spark):
    rng = random.Random(5)
    word = ["a", "ab", "b c", "", "x\ny", "z\r", "abc", " ", "k\u2028m"]
    texts = {f"f{i}": "".join(rng.choice(word) + rng.choice(["\n", "\n", "\r\n", ""]) for _ in range(rng.randrange(9))) for i in range(60)}
    rows = {
        f: [
            (k, rng.choice([None, 0, 1, 1, 2, 3, 3, 4, 50]), rng.choice([None, "", "", "a", "b", " a ", "zz", " "]),
             rng.choice(["a", "b", "", "one", "two words ", "x\ny", None, "q\r"]))
            for k in range(rng.randrange(1, 14))
        ]
        for f in texts
    }
    files = spark.createDataFrame([("r", f, 1, t) for f, t in texts.items()], FILES)
    patches = spark.createDataFrame([("r", f, *row) for f in texts for row in rows[f]], PATCHES).repartition(3)
    want = {f: _in_turn(texts[f], rows[f]) for f in texts}
    for per_round in (1000, 3):
        changed, status = patch.patch_apply(files, patches, per_round)
        assert {r.path: r.content for r in changed.collect()} == {f: c for f, (c, s) in want.items() if set(s) != {"failed"}}
        got = {(r.file, r.ord): r.status for r in status.collect()}
        assert got == {(f, k): s for f in texts for k, s in enumerate(want[f][1])}


def test_five_thousand_line_patches_of_one_file_are_one_pass(spark, monkeypatch):
    text = "".join(f"line {i}\n" for i in range(4000))
    rows = [(k, k * 7 % 4000 + 1, "line" if k % 3 else "", f"line new {k}") for k in range(5000)]
    rows.append((6000, 5000, "", "too far"))
    files = spark.createDataFrame([("r", "f", 1, text)], FILES)
    written = []
    keep = patch.stored
    monkeypatch.setattr(patch, "stored", lambda df, label: written.append(label) or keep(df, label))
    changed, status = patch.patch_apply(files, spark.createDataFrame([("r", "f", *row) for row in rows], PATCHES))
    assert written.count("patches-judged") == 1
    want, statuses = _in_turn(text, rows)
    assert [r.content for r in changed.collect()] == [want]
    assert [r.status for r in status.orderBy("ord").collect()] == statuses


def test_any_number_of_patches_of_one_line_is_one_pass(spark, monkeypatch):
    text = "a\nline\nb\n"
    rows = [(k, 2, ["line", "", "a", None, "new 7"][k * 3 % 5], f"new {k}") for k in range(40)]
    rows = [r for r in rows if r[2] != "a"]
    files = spark.createDataFrame([("r", "f", 1, text)], FILES)
    written, keep = [], patch.stored
    monkeypatch.setattr(patch, "stored", lambda df, label: written.append(label) or keep(df, label))
    always = [(k, line, "" if original == "new 7" else original, new.replace("new", "line")) for k, line, original, new in rows]
    changed, status = patch.patch_apply(files, spark.createDataFrame([("r", "f", *row) for row in always], PATCHES), 3)
    assert written.count("patches-judged") == 1
    want, statuses = _in_turn(text, always)
    assert [r.content for r in changed.collect()] == [want]
    assert [r.status for r in status.orderBy("ord").collect()] == statuses
    want, statuses = _in_turn(text, rows)
    changed, status = patch.patch_apply(files, spark.createDataFrame([("r", "f", *row) for row in rows], PATCHES), 3)
    assert [r.status for r in status.orderBy("ord").collect()] == statuses and [r.content for r in changed.collect()] == [want]


def test_patches_broadcast_nothing(spark, monkeypatch):
    plans, keep = [], patch.stored

    def planned(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(patch, "stored", planned)
    files = spark.createDataFrame([("r", f"f{k}", 1, "a\nb\n") for k in range(4)], FILES)
    patches = spark.createDataFrame([("r", f"f{k}", k, 1 + k % 3, "b", "c") for k in range(4)], PATCHES)
    for part in patch.patch_apply(files, patches, 1):
        planned(part, "out")
    assert plans and not any("Broadcast" in plan for plan in plans)


def test_patches_of_no_file_and_no_patches(spark):
    files = spark.createDataFrame([("r", "f", 1, "a"), ("r", "g", 1, None)], FILES)
    changed, status = patch.patch_apply(files, spark.createDataFrame([], PATCHES))
    assert changed.collect() == [] and status.collect() == []
    twice = [("r", "g", 1, 1, "", "x"), ("r", "f", 1, 1, "a", "a2"), ("r", "f", 1, 1, "a", "a2")]
    changed, status = patch.patch_apply(files, spark.createDataFrame(twice, PATCHES))
    assert [(r.path, r.content) for r in changed.collect()] == [("f", "a2\n")]
    assert sorted((r.file, r.status) for r in status.collect()) == [("f", "line"), ("f", "line"), ("g", "failed")]


def test_overview_and_ranking(spark):
    rows = spark.createDataFrame(
        [("r", i, s) for i, s in enumerate(["low", "critical", None, "odd", "HIGH", "critical"])], "repo string, ord int, severity string"
    )
    assert [r.ord for r in scoring.ranked_findings(rows).collect()] == [1, 5, 4, 0, 2]
    assert [r.ord for r in scoring.ranked_findings(rows, ["low"]).collect()] == [0, 2]
    (o,) = scoring.dashboard_overview(rows).collect()
    assert (o.total, o.critical_high, o.risk_score, o.risk_level) == (6, 2, 60, "Medium")


def test_latest(spark):
    rows = spark.createDataFrame([("r", 1, 5, "a"), ("r", 2, 5, "b"), ("s", 3, 1, "c")], "repo string, ord int, ts int, status string")
    assert {(r.repo, r.status) for r in history.latest_scan(rows).collect()} == {("r", "b"), ("s", "c")}


def test_dedup_is_the_same_for_any_order(spark):
    rows = [("r", "f", 1, "CWE-1104", "sca-x", "high", "same text", f"CVE-{k}", 7) for k in range(6)]
    schema = "repo string, file string, line int, cwe string, rule string, severity string, description string, cve string, ord int"
    got = set()
    for k in range(4):
        shuffled = spark.createDataFrame(rows[k:] + rows[:k], schema).repartition(k + 1)
        got |= {r.cve for r in findings.dedup_findings(shuffled).collect()}
    assert got == {"CVE-0"}
