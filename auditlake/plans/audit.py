"""The whole audit of a table of files, as a few stored tables.

    files -> evidence (one pass over the text) -> findings_raw -> findings_scored -> verdicts

Each stored table is the starting point of the next step, so an export never rescans the
corpus and a lost executor never costs more than the step that is running.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import config
from auditlake.functions.labels import SEVERITIES
from auditlake.functions.text import split_lines, strip
from auditlake.operators import context, deps, enrich, findings, iac, policy, sca, scoring, secrets
from auditlake.operators.corpus import config_kind, scan_stats, scan_warnings, select_scan_sets, shows_exposure
from auditlake.rules.config_rules import CONFIG_RULES, ConfigRule
from auditlake.rules.secret_rules import SECRET_RULES, SecretRule
from auditlake.skew import lookup_join
from auditlake.sources.corpus_store import Corpus
from auditlake.workspace import fresh_path

EVIDENCE = "struct<stage:string,line_no:int,text:string,rule:int,value:string,content:string>"
# Scanner names of a plan by the rank findings carry.
PLAN_NAME = {"ai": "ai", "bandit": "bandit", "codeql": "codeql", "secret": "secrets", "sca": "sca", "iac": "iac"}


def _evidence(stage: str, line: Column, text: Column, rule: Column, value: Column, content: Column) -> Column:
    return F.struct(
        F.lit(stage).alias("stage"),
        line.cast("int").alias("line_no"),
        text.cast("string").alias("text"),
        rule.cast("int").alias("rule"),
        value.cast("string").alias("value"),
        content.cast("string").alias("content"),
    )


def scan_pass(
    files: DataFrame,
    secret_rules: list[SecretRule] = SECRET_RULES,
    config_rules: list[ConfigRule] = CONFIG_RULES,
    max_bytes: int | None = None,
) -> DataFrame:
    """Everything the detectors need from the text, in a single pass without a shuffle.

    Rows (repo, file, stage, line_no, text, rule, value, content) with stage 'secret' or
    'config' (a rule hit on a line), 'root' (the user of a Dockerfile), 'exposure' (a file
    that shows network exposure) and 'manifest' (the text of a dependency file, a small part
    of a corpus). Stateless, so it also runs on a stream of files.
    """
    none = F.lit(None)
    path, content = F.col("path"), F.col("content")
    marked = (
        select_scan_sets(files, max_bytes)
        .withColumn("kind", F.when(F.col("for_config"), config_kind(path, content)))
        .withColumn("secret_file", F.col("for_secrets") & secrets.may_hold_secret(content, secret_rules))
        .withColumn("exposed", F.col("for_exposure") & shows_exposure(content))
    )
    split = F.when(F.col("kind").isNotNull() | F.col("secret_file"), split_lines(content)).otherwise(
        F.array().cast("array<string>")
    )
    per_file = marked.select(
        "repo",
        F.col("path").alias("file"),
        "kind",
        "secret_file",
        "exposed",
        F.when(F.col("for_dependencies"), content).alias("manifest"),
        split.alias("lines"),
    ).withColumn("root", F.when(F.col("kind") == "dockerfile", iac.root_user(F.col("lines"))))

    # Position 0 stands for the file itself, position n for line n.
    rows = per_file.select(
        "repo",
        "file",
        "kind",
        "secret_file",
        "exposed",
        "manifest",
        "root",
        F.when(F.col("root").isNotNull(), strip(F.coalesce(F.get("lines", F.col("root.line") - 1), F.lit("")))).alias(
            "root_text"
        ),
        F.posexplode(F.concat(F.array(F.lit("")), F.col("lines"))).alias("line_no", "text"),
    ).filter(
        (F.col("line_no") == 0)
        | (F.col("secret_file") & secrets.may_hold_secret(F.col("text"), secret_rules))
        | (F.col("kind").isNotNull() & iac.may_hit_config(F.col("text"), config_rules))
    )
    of_file = F.array_compact(
        F.array(
            F.when(F.col("exposed"), _evidence("exposure", none, none, none, none, none)),
            F.when(F.col("manifest").isNotNull(), _evidence("manifest", none, none, none, none, F.col("manifest"))),
            F.when(
                F.col("root").isNotNull(),
                _evidence("root", F.col("root.line"), F.col("root_text"), F.col("root.case"), none, none),
            ),
        )
    )
    is_line = F.col("line_no") > 0
    found = rows.withColumn("stripped", strip(F.col("text"))).withColumns(
        {
            "secret_hits": F.when(
                is_line & F.col("secret_file") & secrets.may_hold_secret(F.col("text"), secret_rules),
                secrets.secret_hits(F.col("text"), secret_rules),
            ),
            "config_hits": F.when(
                is_line & F.col("kind").isNotNull(),
                iac.config_hits(F.col("kind"), F.col("stripped"), config_rules),
            ),
        }
    )
    line, text = F.col("line_no"), F.col("stripped")
    empty = F.array().cast(f"array<{EVIDENCE}>")
    of_line = F.concat(
        F.coalesce(
            F.transform("secret_hits", lambda h: _evidence("secret", line, text, h["rule"], h["value"], none)), empty
        ),
        F.coalesce(F.transform("config_hits", lambda i: _evidence("config", line, text, i, none, none)), empty),
    )
    evidence = F.when(is_line, of_line).otherwise(of_file)
    return found.select("repo", "file", F.explode(evidence).alias("e")).select("repo", "file", "e.*")


def line_findings(
    evidence: DataFrame,
    secret_rules: list[SecretRule] = SECRET_RULES,
    config_rules: list[ConfigRule] = CONFIG_RULES,
) -> DataFrame:
    """Findings of the secret and configuration scanners from the evidence rows."""
    place = ["repo", "file", "line_no", "text"]
    hits = evidence.filter("stage = 'secret'").select(*place, F.struct("rule", "value").alias("hit"))
    config_rows = evidence.filter("stage = 'config'").select(*place, F.col("rule").alias("hit"))
    roots = evidence.filter("stage = 'root'").select(
        "repo",
        "file",
        F.struct(F.col("line_no").alias("line"), F.col("rule").alias("case")).alias("root"),
        F.col("text").alias("sink"),
    )
    return (
        secrets.secret_findings(hits, secret_rules)
        .unionByName(iac.config_findings(config_rows, config_rules))
        .unionByName(iac.root_findings(roots))
    )


def manifest_deps(evidence: DataFrame) -> DataFrame:
    files = evidence.filter("stage = 'manifest'").select(
        "repo", F.col("file").alias("path"), F.lit(0).cast("bigint").alias("size"), "content"
    )
    return deps.extract_deps(files)


def allowed(found: DataFrame, plan: DataFrame, planned: DataFrame) -> DataFrame:
    """Keep the findings of scanners that the plan (repo, scanner) lists for the repository.

    A repository of ``planned`` (repo) that the plan does not list runs no scanner. Findings of a scanner without a
    name of its own, and of repositories that were not planned, pass.
    """
    name = F.when(F.lit(False), "")
    for scanner, rank in config.SCANNER_RANK.items():
        name = name.when(F.col("ord.scanner") == rank, PLAN_NAME[scanner])
    runs = plan.groupBy("repo").agg(F.collect_set("scanner").alias("_runs"))
    runs = planned.select("repo").distinct().join(runs, "repo", "left")
    runs = runs.withColumn("_runs", F.coalesce("_runs", F.array().cast("array<string>")))
    return (
        lookup_join(found, runs, ["repo"], ["file", "line", "rule", "ord"])
        .filter(F.coalesce(F.array_contains("_runs", name), F.lit(True)))
        .drop("_runs")
    )


def score(unique: DataFrame, files: DataFrame | Corpus, exposed: DataFrame) -> DataFrame:
    """Add context to deduplicated findings and compute the risk of each place."""
    with_line = context.sink_lookup(findings.finding_defaults(unique), files)
    reachable = context.reachability(with_line, files)
    return scoring.risk_score(scoring.add_exposure(context.fingerprint(reachable), exposed))


@dataclass
class Audit:
    """The stored tables of one audit."""

    raw: DataFrame
    dependencies: DataFrame
    scored: DataFrame
    verdicts: DataFrame
    summary: DataFrame
    warnings: DataFrame


def run_audit(
    files: DataFrame | Corpus,
    vulnerabilities: DataFrame,
    cwe_dim: DataFrame,
    guidance: DataFrame,
    policies: DataFrame | None = None,
    reports: list[DataFrame] | None = None,
    profile: str = "comprehensive",
    out: str | None = None,
    max_bytes: int | None = None,
    reported_dependencies: DataFrame | None = None,
) -> Audit:
    """Audit all repositories of ``files`` and ``reports`` and store the results below ``out``.

    ``reports`` are findings ingested from other tools, ``policies`` the policy files as rows. Source files above
    ``max_bytes`` are not scanned (by default all are) and listed in ``warnings``. ``reported_dependencies`` (from
    ``ingest_osv_deps``) join the inventory; their findings come with the reports. Of a ``Corpus`` (``store_corpus``) no lookup
    shuffles file text, however many lines and package names are looked up.
    """
    text = files
    if isinstance(files, Corpus):
        files = files.files()
    spark = files.sparkSession
    base = out or fresh_path(spark, "audit")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    evidence_path = f"{base}/evidence"
    scanned = scan_pass(files, max_bytes=max_bytes)
    scanned.write.mode("overwrite").partitionBy("stage").parquet(evidence_path)
    evidence = spark.read.schema(scanned.schema).parquet(evidence_path)

    known = files.select("repo")
    for report in reports or []:
        known = known.unionByName(report.select("repo"))
    if reported_dependencies is not None:
        known = known.unionByName(reported_dependencies.select("repo"))
    repos = keep(known.distinct(), "repos")
    warnings = keep(scan_warnings(files, max_bytes), "warnings")
    exposed = keep(
        evidence.filter("stage = 'exposure'").select("repo").distinct().withColumn("internet_exposed", F.lit(True)),
        "exposure",
    )
    resolved = plan = None
    if policies is not None:
        resolved = keep(policy.policy_merge(repos, policies), "policies")
        plan = policy.scanner_plan(resolved, profile)

    def listed(deps: DataFrame) -> DataFrame:
        """Dependencies of the repositories whose policy leaves their scanner on."""
        if plan is None:
            return deps
        return lookup_join(deps, plan.filter(F.col("scanner") == PLAN_NAME["sca"]).select("repo"), ["repo"], ["file", "line"], "left_semi")

    own = keep(listed(manifest_deps(evidence)), "own_dependencies")
    dependencies = own
    if reported_dependencies is not None:
        dependencies = keep(own.unionByName(listed(reported_dependencies)), "dependencies")
    parts = [line_findings(evidence), sca.sca_match(own, vulnerabilities), *(reports or [])]
    every = findings.finding_union(*parts)
    if plan is not None:
        every = allowed(every, plan, repos)
    raw = keep(enrich.cwe_enrich(every, cwe_dim), "findings_raw")
    unique = keep(findings.dedup_findings(raw), "findings_unique")
    scored = keep(enrich.remediation_join(score(unique, text, exposed), guidance), "findings_scored")

    counts = repos.join(scoring.severity_counts(scored), "repo", "left").na.fill(0, SEVERITIES)
    if resolved is None:
        resolved = policy.policy_join(repos, repos.selectExpr(
            "repo", "CAST(NULL AS ARRAY<STRING>) AS fail_on", "CAST(NULL AS ARRAY<STRUCT<sev:STRING,limit:INT>>) AS thresholds"
        ))
    verdicts = keep(scoring.gate(counts, resolved), "verdicts")
    stats = scan_stats(files, raw, max_bytes)
    summary = scoring.report_summary(raw, scored, verdicts).join(stats, "repo", "left").na.fill(0, ["scanned_files", "skipped_files", "bandit", "codeql"])
    summary = keep(summary, "summary")
    return Audit(raw, dependencies, scored, verdicts, summary, warnings)
