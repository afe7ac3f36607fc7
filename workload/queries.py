"""Registered queries: every operator on whole tables, or on corpora Spark derives from them."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake import config
from auditlake.exports import report, review, sarif, sbom
from auditlake.operators import (
    context,
    corpus,
    deps,
    enrich,
    findings,
    history,
    iac,
    patch,
    policy,
    sca,
    scoring,
    secrets,
)
from auditlake.plans import audit
from auditlake.rules.templates import templates
from auditlake.rules.vuln_db import vuln_db
from auditlake.rules.weaknesses import cwe_dim, guidance
from auditlake.sources import files as file_sources
from auditlake.sources import reports
from auditlake.sources.corpus_store import Corpus, store_corpus
from auditlake.sources.catalog import read_weaknesses
from auditlake.streaming import latest as stream_latest_job
from auditlake.streaming import reviews as stream_reviews
from auditlake.streaming import scan as stream_scan_job
from auditlake.workspace import fresh_path, stored
from workload.corpora import CORPORA

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
STAMP = "2024-01-31T00:00:00Z"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived corpus as a lazy DataFrame."""
    for t in TABLES:
        if f" {t}" in CORPORA[name]:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(CORPORA[name])


def corpus_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived corpus laid out as a stored table of files, as a real corpus is."""
    return stored(load(spark, sf_dir, name).repartition(32), name)


def joined(name: str, sep: str = ",") -> Column:
    return F.array_join(name, sep).alias(name)


# --- Corpus selection -----------------------------------------------------------------------


@query
def corpus_load(spark, sf_dir):
    """Documents written as files of repositories, some hidden, some with invalid bytes, and read back from the directories."""
    folder = fresh_path(spark, "trees").removeprefix("file://")
    written = file_sources.write_files(load(spark, sf_dir, "tree_files"), folder)
    roots = written.select("repo").distinct().select("repo", F.concat(F.lit(folder + "/"), "repo").alias("root"))
    loaded = file_sources.corpus_load(roots, range_bytes=3 * 1024)
    return loaded.select("repo", "path", "size", F.sha2("content", 256).alias("content_sha256"), F.col("error").isNull().alias("read"))


@query
def prune_ignored_dirs(spark, sf_dir):
    return corpus.prune_ignored_dirs(load(spark, sf_dir, "mixed_files")).select("repo", "path", "size")


@query
def select_by_extension(spark, sf_dir):
    return corpus.select_by_extension(load(spark, sf_dir, "mixed_files")).select("repo", "path")


@query
def size_limit(spark, sf_dir):
    return corpus.size_limit(load(spark, sf_dir, "mixed_files"), config.MAX_FILE_BYTES).select("repo", "path", "size")


@query
def select_scan_sets(spark, sf_dir):
    return corpus.select_scan_sets(load(spark, sf_dir, "mixed_files"), config.MAX_FILE_BYTES).drop("content", "size")


@query
def stage_filter(spark, sf_dir):
    return corpus.stage_filter(load(spark, sf_dir, "mixed_files"), config.MAX_FILE_BYTES).select("repo", "path")


@query
def decode_lossy(spark, sf_dir):
    """Page bytes with an invalid byte put behind each '<'; the byte must vanish."""
    from auditlake.functions.text import decode_lossy as decode

    broken = F.concat(
        F.to_binary(F.hex(F.encode("html", "utf-8")), F.lit("hex")), F.to_binary(F.lit("FF41C3"), F.lit("hex"))
    )
    text = decode(broken)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"))


@query
def explode_lines(spark, sf_dir):
    return corpus.explode_lines(load(spark, sf_dir, "code_files")).select(
        "repo", "file", F.col("line_no").cast("bigint").alias("line_no"), "text"
    )


@query
def classify_config(spark, sf_dir):
    return corpus.classify_config(load(spark, sf_dir, "mixed_files")).select("repo", "path", "kind")


@query
def review_candidates(spark, sf_dir):
    return corpus.review_candidates(load(spark, sf_dir, "mixed_files"), config.REVIEW_FILES_PER_REPO, config.MAX_FILE_BYTES).select(
        "repo", "path", F.col("rank").cast("bigint").alias("rank")
    )


@query
def scan_warnings(spark, sf_dir):
    return corpus.scan_warnings(load(spark, sf_dir, "mixed_files"), config.MAX_FILE_BYTES)


@query
def scan_stats(spark, sf_dir):
    files = load(spark, sf_dir, "mixed_files")
    found = findings.finding_union(
        reports.ingest_bandit(load(spark, sf_dir, "bandit_reports").withColumn("repo", F.replace("repo", F.lit("repo"), F.lit("src")))),
        reports.ingest_codeql_marker(
            load(spark, sf_dir, "tool_status").withColumn("repo", F.replace("repo", F.lit("repo"), F.lit("src")))
        ),
    )
    return corpus.scan_stats(files, found, config.MAX_FILE_BYTES)


@query
def scanner_plan(spark, sf_dir):
    resolved = _policies(spark, sf_dir)
    parts = [
        policy.scanner_plan(resolved, p).select("repo", F.lit(p).alias("profile"), "scanner")
        for p in policy.PROFILES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _policy_rows(spark, sf_dir) -> DataFrame:
    flat = load(spark, sf_dir, "policy_files")

    def limit(sev: str) -> Column:
        return F.when(F.col(sev).isNotNull(), F.struct(F.lit(sev).alias("sev"), F.col(sev).alias("limit")))

    def flag(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("key"), F.col(name).alias("value")))

    no = F.lit(None)
    return flat.select(
        "repo",
        "file_name",
        "parsed",
        F.split("fail_on", ",").alias("fail_on"),
        F.map_from_entries(F.array_compact(F.array(flag("secrets"), flag("sast")))).alias("scanners"),
        F.array_compact(F.array(limit("medium"), limit("high"), limit("low"))).alias("thresholds"),
        F.struct(
            no.cast("boolean").alias("network"),
            F.col("timeout"),
            no.cast("string").alias("memory"),
            no.cast("int").alias("cpu"),
        ).alias("sandbox"),
    )


def _policies(spark, sf_dir) -> DataFrame:
    return policy.policy_merge(load(spark, sf_dir, "policy_repos"), _policy_rows(spark, sf_dir))


def _threshold_text() -> Column:
    return F.array_join(F.transform("thresholds", lambda t: F.concat(t["sev"], F.lit("="), t["limit"])), ",").alias(
        "thresholds"
    )


@query
def policy_merge(spark, sf_dir):
    return _policies(spark, sf_dir).select(
        "repo",
        joined("fail_on"),
        _threshold_text(),
        *[F.col("scanners")[s].alias(f"scan_{s}") for s in config.DEFAULT_SCANNERS],
        F.col("sandbox.network").alias("network"),
        F.col("sandbox.timeout").cast("bigint").alias("timeout"),
        F.col("sandbox.memory").alias("memory"),
        F.col("sandbox.cpu").cast("bigint").alias("cpu"),
    )


@query
def policy_join(spark, sf_dir):
    repos = load(spark, sf_dir, "findings").select("repo").distinct()
    return policy.policy_join(repos, _policies(spark, sf_dir)).select("repo", joined("fail_on"), _threshold_text())


@query
def display_path(spark, sf_dir):
    return load(spark, sf_dir, "findings").select(
        "ord", corpus.display_path(F.col("repo"), F.col("file")).alias("file")
    )


# --- Reports --------------------------------------------------------------------------------


@query
def ingest_bandit(spark, sf_dir):
    return reports.ingest_bandit(load(spark, sf_dir, "bandit_reports")).select(
        "repo", "file", F.col("line").cast("bigint").alias("line"), "rule", "cwe", "severity", "description"
    )


@query
def map_bandit_cwe(spark, sf_dir):
    """Weakness ids in the forms reports use: numbers, bare text, prefixed text, zero, none."""
    event = F.col("event_id")
    raw = (
        F.when(event % 5 == 0, F.concat(F.lit("CWE-"), (event % 90).cast("string")))
        .when(event % 5 == 1, (event % 90).cast("string"))
        .when(event % 5 == 2, F.lit("0"))
        .when(event % 5 == 3, F.lit(""))
    )
    return table(spark, sf_dir, "events").select("event_id", reports.bandit_cwe(raw).alias("cwe"))


@query
def ingest_codeql_marker(spark, sf_dir):
    return reports.ingest_codeql_marker(load(spark, sf_dir, "tool_status")).select(
        "repo", "rule", "cwe", "severity", "description", F.col("line").cast("bigint").alias("line")
    )


@query
def ingest_gitleaks(spark, sf_dir):
    return reports.ingest_gitleaks(load(spark, sf_dir, "gitleaks_reports")).select(
        "repo", "file", F.col("line").cast("bigint").alias("line"), "rule", "provider", "secret", "description", "type"
    )


@query
def ingest_osv(spark, sf_dir):
    return reports.ingest_osv(load(spark, sf_dir, "osv_reports")).select(
        "repo", "file", "rule", "package", "installed", "cve", "severity", "description"
    )


@query
def ingest_osv_deps(spark, sf_dir):
    return reports.ingest_osv_deps(load(spark, sf_dir, "osv_reports")).select("repo", "file", "package", "version")


@query
def ingest_ai_review(spark, sf_dir):
    return reports.ingest_ai_review(load(spark, sf_dir, "ai_answers")).select(
        "repo", "file", F.col("line").cast("bigint").alias("line"), "rule", "cwe", "severity", "description"
    )


@query
def ingest_pr_event(spark, sf_dir):
    return reports.ingest_pr_event(load(spark, sf_dir, "pr_bodies")).select(
        "ord", "repo", "pr_number", "commit_sha", "branch"
    )


# --- Detectors ------------------------------------------------------------------------------


def _secret_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "repo", "file", F.col("line").cast("bigint").alias("line"), "rule", "provider", "secret", "description"
    )


@query
def secret_scan(spark, sf_dir):
    return _secret_columns(secrets.secret_scan(load(spark, sf_dir, "code_files")))


@query
def secret_providers(spark, sf_dir):
    """The same scan on files with tokens of every provider."""
    return _secret_columns(secrets.secret_scan(corpus_table(spark, sf_dir, "token_files")))


def _dep_columns(df: DataFrame) -> DataFrame:
    return df.select("repo", "file", F.col("line").cast("bigint").alias("line"), "package", "version")


def _requirement_deps(spark, sf_dir) -> DataFrame:
    return deps.line_deps(load(spark, sf_dir, "requirement_lines"), ["requirements.txt"])


@query
def deps_requirements(spark, sf_dir):
    return _dep_columns(_requirement_deps(spark, sf_dir))


def _manifest_query(key: str, corpus_name: str, manifest: str) -> None:
    def run(spark, sf_dir):
        return _dep_columns(deps.extract_deps(corpus_table(spark, sf_dir, corpus_name), [manifest]))

    QUERIES[key] = run


for _key, _corpus, _name in [
    ("deps_package_lock", "package_lock_files", "package-lock.json"),
    ("deps_pom", "pom_files", "pom.xml"),
    ("deps_go_mod", "go_files", "go.mod"),
    ("deps_cargo", "cargo_files", "cargo.lock"),
    ("deps_poetry", "poetry_files", "poetry.lock"),
    ("deps_gemfile", "gemfile_files", "gemfile.lock"),
    ("deps_composer", "composer_files", "composer.lock"),
    ("deps_pipfile", "pipfile_files", "pipfile.lock"),
    ("deps_yarn", "yarn_files", "yarn.lock"),
    ("deps_pnpm", "pnpm_files", "pnpm-lock.yaml"),
    ("deps_gradle", "gradle_files", "build.gradle"),
]:
    _manifest_query(_key, _corpus, _name)


def _all_manifests(spark, sf_dir) -> DataFrame:
    names = [
        "pom_files", "go_files", "cargo_files", "poetry_files", "gemfile_files", "yarn_files",
        "pnpm_files", "gradle_files", "package_lock_files", "composer_files", "pipfile_files",
    ]
    every = load(spark, sf_dir, names[0])
    for name in names[1:]:
        every = every.unionByName(load(spark, sf_dir, name))
    return stored(every.repartition(32), "manifests")


@query
def extract_deps(spark, sf_dir):
    """All manifest kinds of the corpus together."""
    return _dep_columns(deps.extract_deps(_all_manifests(spark, sf_dir)))


@query
def sca_match(spark, sf_dir):
    return sca.sca_match(_requirement_deps(spark, sf_dir), vuln_db(spark)).select(
        "repo",
        "file",
        F.col("line").cast("bigint").alias("line"),
        "rule",
        "severity",
        "package",
        "installed",
        "affected",
        "cve",
        "fix",
        "description",
    )


@query
def sca_match_ranges(spark, sf_dir):
    """A large advisory table: versions meet the sorted bounds of ranges."""
    found = sca.sca_match(_requirement_deps(spark, sf_dir), load(spark, sf_dir, "advisories"))
    return found.select("repo", "file", F.col("line").cast("bigint").alias("line"), "severity", "package", "installed", "affected", "cve", "fix")


def _config_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "repo", "file", F.col("line").cast("bigint").alias("line"), "rule", "cwe", "severity", "description",
        "rule_remediation",
    )


@query
def iac_dockerfile(spark, sf_dir):
    return _config_columns(iac.iac_scan(corpus_table(spark, sf_dir, "docker_files")))


def _config_query(key: str, kind: str) -> None:
    def run(spark, sf_dir):
        lines = load(spark, sf_dir, "config_lines")
        return _config_columns(iac.iac_lines(lines.filter(F.col("kind") == kind)))

    QUERIES[key] = run


CONFIG_KINDS = {
    "iac_compose": "compose",
    "iac_terraform": "terraform",
    "iac_kubernetes": "kubernetes",
    "iac_cloudformation": "cloudformation",
    "iac_github_actions": "github-actions",
    "iac_gitlab": "gitlab",
    "iac_jenkins": "jenkins",
}
for _key, _kind in CONFIG_KINDS.items():
    _config_query(_key, _kind)


# --- Joins ----------------------------------------------------------------------------------


@query
def cwe_enrich(spark, sf_dir):
    rows = load(spark, sf_dir, "findings").withColumn(
        "cwe",
        F.when(F.col("ord") % 11 == 0, "CWE-99999")
        .when(F.col("ord") % 13 == 0, "weird")
        .when(F.col("ord") % 17 == 0, " cwe-79 ")
        .otherwise(F.col("cwe")),
    )
    return enrich.cwe_enrich(rows, cwe_dim(spark)).select("ord", "cwe_title", "cwe_description")


@query
def cwe_enrich_catalog(spark, sf_dir):
    """Titles and texts from a catalog in XML, which Spark writes with an entry per part."""
    number = F.col("p_partkey")
    entries = table(spark, sf_dir, "part").select(
        number.alias("_ID"),
        F.when(number % 7 != 0, F.concat(F.lit("Weak <"), "p_name", F.lit('> & "'), number.cast("string"), F.lit('"'))).alias("_Name"),
        F.when(number % 11 != 0, F.concat(F.lit("Entry of "), "p_name", F.lit(" & <others>"))).alias("Description"),
    )
    path = fresh_path(spark, "catalog")
    entries.write.format("xml").options(rootTag="Weakness_Catalog", rowTag="Weakness").save(path)
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit("cwe-1000"), F.col("l_partkey").cast("string")))
        .otherwise(F.concat(F.lit(" CWE-"), F.col("l_partkey").cast("string"))).alias("cwe"),
    )
    return enrich.cwe_enrich(rows, read_weaknesses(spark, path)).select("l_orderkey", "l_linenumber", "cwe_title", "cwe_description")


@query
def remediation_join(spark, sf_dir):
    return enrich.remediation_join(load(spark, sf_dir, "findings"), guidance(spark)).select("ord", "cwe", "remediation")


def _with_sink(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "findings").withColumn(
        "sink", F.when(F.col("ord") % 3 == 0, "").otherwise(F.concat(F.lit("code "), F.col("ord").cast("string")))
    )


@query
def template_join(spark, sf_dir):
    d = F.col("details")
    names = ["why", "source", "sink", "exploit", "cwe", "fix_desc", "original_code", "secure_code"]
    flow = F.transform(
        d["data_flow"],
        lambda s: F.concat_ws("|", s["step"].cast("string"), s["type"], s["label"], s["code"], s["description"]),
    )
    return enrich.template_join(_with_sink(spark, sf_dir), templates(spark)).select(
        "ord", *[d[n].alias(f"t_{n}") for n in names], F.array_join(flow, "\n").alias("t_flow")
    )


def _located(spark, sf_dir) -> DataFrame:
    """Findings with the text of their line."""
    return context.sink_lookup(load(spark, sf_dir, "findings"), load(spark, sf_dir, "finding_files"))


@query
def sink_lookup(spark, sf_dir):
    return _located(spark, sf_dir).select("ord", "sink")


def _in_buckets(spark, sf_dir, name: str, source: str) -> Corpus:
    """A corpus derived from a table stored for lookups, apart from every seventh file, which came later.

    The table is read in parts of bounded size; the number of buckets follows them.
    """
    files = load(spark, sf_dir, name)
    late = F.pmod(F.xxhash64("path"), F.lit(7)) == 0
    buckets = max(8, 4 * table(spark, sf_dir, source).rdd.getNumPartitions())
    return store_corpus(files.filter(~late), buckets).plus(files.filter(late))


@query
def sink_lookup_buckets(spark, sf_dir):
    """The same lines from a corpus in buckets, whose text no join shuffles."""
    located = context.sink_lookup(load(spark, sf_dir, "findings"), _in_buckets(spark, sf_dir, "finding_files", "events"))
    return located.select("ord", "sink")


@query
def fingerprint(spark, sf_dir):
    return context.fingerprint(_located(spark, sf_dir)).select("ord", "fingerprint")


@query
def finding_lookup(spark, sf_dir):
    """Requests for the fingerprint of every finding, and some that match nothing."""
    marked = context.fingerprint(_located(spark, sf_dir)).select("ord", "repo", "file", "line", "cwe", "rule", "fingerprint")
    asked = F.when(F.col("ord") % 9 == 0, F.sha2(F.col("ord").cast("string"), 256)).otherwise(F.col("fingerprint"))
    requests = marked.select(F.col("ord").alias("request_id"), asked.alias("fingerprint"))
    return findings.finding_lookup(marked, requests).select("request_id", "ord", "rule", "cwe")


@query
def reachability(spark, sf_dir):
    found = sca.sca_match(_requirement_deps(spark, sf_dir), vuln_db(spark))
    marked = context.reachability(found, load(spark, sf_dir, "import_files"))
    return marked.select("repo", F.col("line").cast("bigint").alias("line"), "package", "reachable")


@query
def reachability_postings(spark, sf_dir):
    """The same marks by trigram postings; only candidate files are tested, in their buckets."""
    found = sca.sca_match(_requirement_deps(spark, sf_dir), vuln_db(spark))
    marked = context.reachability(found, _in_buckets(spark, sf_dir, "import_files", "documents"))
    return marked.select("repo", F.col("line").cast("bigint").alias("line"), "package", "reachable")


@query
def exposure(spark, sf_dir):
    every = load(spark, sf_dir, "code_files").unionByName(load(spark, sf_dir, "finding_files")).unionByName(
        load(spark, sf_dir, "mixed_files").withColumn("repo", F.concat(F.lit("x"), "repo"))
    )
    return context.exposure(every)


@query
def patch_apply(spark, sf_dir):
    changed, _ = patch.patch_apply(load(spark, sf_dir, "docker_files"), load(spark, sf_dir, "patches"))
    return changed.select("repo", "path", "size", "content")


def _line_patches(spark, sf_dir):
    return patch.patch_apply(load(spark, sf_dir, "patched_files"), load(spark, sf_dir, "line_patches"))


@query
def patch_lines(spark, sf_dir):
    """Many patches of one file."""
    return _line_patches(spark, sf_dir)[0].select("repo", "path", "size", "content")


@query
def patch_lines_status(spark, sf_dir):
    return _line_patches(spark, sf_dir)[1].select("repo", "file", "ord", "status")


@query
def patch_status(spark, sf_dir):
    _, statuses = patch.patch_apply(load(spark, sf_dir, "docker_files"), load(spark, sf_dir, "patches"))
    return statuses.select("repo", "file", "ord", "status")


# --- Deduplication, scoring, gate -----------------------------------------------------------


def _flagged(spark, sf_dir) -> DataFrame:
    """Deduplicated findings with context flags derived from their place."""
    unique = findings.dedup_findings(load(spark, sf_dir, "findings"))
    return unique.withColumn(
        "reachable", F.when(F.coalesce(F.col("line"), F.lit(0)) % 3 == 1, "NO").otherwise("YES")
    ).withColumn("internet_exposed", F.when(F.col("repo").isin("repo1", "repo4", "repo5", "repo8"), "YES").otherwise("NO"))


def _scored(spark, sf_dir) -> DataFrame:
    return scoring.risk_score(_flagged(spark, sf_dir))


def _line() -> Column:
    return F.col("line").cast("bigint").alias("line")


@query
def finding_union(spark, sf_dir):
    every = findings.finding_union(
        secrets.secret_scan(load(spark, sf_dir, "code_files")),
        iac.iac_scan(load(spark, sf_dir, "docker_files")),
        sca.sca_match(_requirement_deps(spark, sf_dir), vuln_db(spark)),
        reports.ingest_bandit(load(spark, sf_dir, "bandit_reports")),
    )
    return every.select("repo", "file", _line(), "rule", "cwe", "severity", "type")


@query
def finding_defaults(spark, sf_dir):
    raw = load(spark, sf_dir, "findings").withColumn("code", F.lit("x = 1")).withColumn(
        "cve", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("CVE-"), F.col("ord").cast("string")))
    )
    return findings.finding_defaults(raw).select("ord", "cve", "rule")


@query
def dedup_findings(spark, sf_dir):
    return findings.dedup_findings(load(spark, sf_dir, "findings")).select(
        "repo", "file", _line(), "cwe", "ord", "rule", "severity", "description", joined("detected_by"),
        F.col("confidence").cast("bigint").alias("confidence"),
        F.col("reports").cast("bigint").alias("reports"),
    )


@query
def detector_set(spark, sf_dir):
    kinds = F.when(F.col("ord") % 8 == 0, "SECRET").when(F.col("ord") % 8 == 1, "iac").when(F.col("ord") % 8 == 2, "SCA")
    rules = (
        F.when(F.col("ord") % 10 == 0, "gitleaks-secret")
        .when(F.col("ord") % 10 == 1, "chain-check")
        .when(F.col("ord") % 10 == 2, "ai-custom")
        .when(F.col("ord") % 10 == 3, "AI-Cursor-x")
        .when(F.col("ord") % 10 == 4, "my-ollama")
        .otherwise(F.col("rule"))
    )
    raw = load(spark, sf_dir, "findings").withColumn("type", kinds).withColumn("rule", rules)
    return findings.detector_set(raw).select("repo", "file", _line(), "cwe", joined("detected_by"))


@query
def combined_confidence(spark, sf_dir):
    return findings.detector_set(load(spark, sf_dir, "findings")).select(
        "repo", "file", _line(), "cwe", F.col("confidence").cast("bigint").alias("confidence")
    )


@query
def risk_score(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "repo",
        "file",
        _line(),
        "cwe",
        F.col("cvss").cast("double").alias("cvss"),
        "exploitability",
        F.col("risk_score").cast("double").alias("risk_score"),
        "severity",
    )


@query
def severity_counts(spark, sf_dir):
    return scoring.severity_counts(_scored(spark, sf_dir))


def _verdicts(spark, sf_dir) -> DataFrame:
    counts = scoring.severity_counts(_scored(spark, sf_dir))
    return scoring.gate(counts, _policies(spark, sf_dir))


@query
def gate(spark, sf_dir):
    return _verdicts(spark, sf_dir).select(
        "repo", "critical", "high", "medium", "low", "gate_status", joined("gate_reasons", "; ")
    )


@query
def report_summary(spark, sf_dir):
    raw = load(spark, sf_dir, "findings")
    return scoring.report_summary(raw, _scored(spark, sf_dir), _verdicts(spark, sf_dir)).select(
        "repo", "finding_count", joined("covered_cwes"), "risk_level", "gate_status"
    )


@query
def dashboard_overview(spark, sf_dir):
    return scoring.dashboard_overview(_scored(spark, sf_dir)).select(
        "repo", "total", "critical_high", F.col("risk_score").cast("bigint").alias("risk_score"), "risk_level",
        "risk_message",
    )


def _placed(ordered: DataFrame) -> DataFrame:
    """The place, from 1, that each row has among its repository's rows in the order of the frame."""
    within = Window.partitionBy("repo").orderBy("_at")
    numbered = ordered.withColumn("_at", F.monotonically_increasing_id())
    return numbered.withColumn("position", F.row_number().over(within).cast("bigint")).drop("_at")


@query
def ranked_findings(spark, sf_dir):
    raw = load(spark, sf_dir, "findings").withColumn(
        "severity",
        F.when(F.col("ord") % 10 == 0, None).when(F.col("ord") % 10 == 1, "info").otherwise(F.upper("severity")),
    )
    return _placed(scoring.ranked_findings(raw, ["critical", "high", "low"])).select(
        "ord", "repo", F.col("rank").cast("bigint").alias("rank"), "rule", "position"
    )


@query
def latest_scan(spark, sf_dir):
    return history.latest_scan(load(spark, sf_dir, "scan_history"))


@query
def newest_first(spark, sf_dir):
    return _placed(history.newest_first(load(spark, sf_dir, "scan_history"))).select("repo", "ord", "status", "position")


# --- Exports --------------------------------------------------------------------------------


@query
def sbom_components(spark, sf_dir):
    return sbom.sbom_components(deps.extract_deps(_all_manifests(spark, sf_dir))).select(
        "repo", "package", "version", "file", "purl"
    )


def _repos(df: DataFrame) -> DataFrame:
    return df.select("repo").distinct()


def _lines_out(lines: DataFrame) -> DataFrame:
    """Lines with their place in the part."""
    place = F.row_number().over(Window.partitionBy("repo", "part").orderBy("ord", "tie"))
    return lines.select("repo", F.col("part").cast("bigint").alias("part"), place.cast("bigint").alias("place"), "line")


@query
def cyclonedx_export(spark, sf_dir):
    found = _requirement_deps(spark, sf_dir)
    return _lines_out(sbom.cyclonedx_export(found, _repos(found), STAMP))


@query
def spdx_export(spark, sf_dir):
    found = _requirement_deps(spark, sf_dir)
    return _lines_out(sbom.spdx_export(found, _repos(found), STAMP))


def _enriched(spark, sf_dir) -> DataFrame:
    return enrich.cwe_enrich(load(spark, sf_dir, "findings"), cwe_dim(spark))


@query
def sarif_rules(spark, sf_dir):
    return sarif.sarif_rules(_enriched(spark, sf_dir)).select(
        "repo", "rule_id", "name", "short_description", "full_description", "help_uri"
    )


@query
def sarif_results(spark, sf_dir):
    return sarif.sarif_results(_enriched(spark, sf_dir)).select(
        "ord", "repo", "rule_id", "level", "message", "uri", F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"),
    )


@query
def sarif_export(spark, sf_dir):
    rows = _enriched(spark, sf_dir)
    return _lines_out(sarif.sarif_export(rows, _repos(rows)))


@query
def report_export(spark, sf_dir):
    """Reports written as files and read back."""
    rows = load(spark, sf_dir, "findings")
    summary = rows.groupBy("repo").agg(F.count(F.lit(1)).alias("finding_count"))
    out = fresh_path(spark, "reports")
    report.report_export(rows, summary, out)
    return spark.read.schema("value STRING, repo STRING").text(out).select(F.col("value").alias("line"), "repo")


def _pr_events(spark, sf_dir) -> DataFrame:
    return reports.ingest_pr_event(load(spark, sf_dir, "pr_bodies"))


@query
def pr_check_run(spark, sf_dir):
    return review.pr_check_run(_pr_events(spark, sf_dir), _verdicts(spark, sf_dir)).select(
        "ord", "repo", "pr_number", "commit_sha", "conclusion", "title", "summary"
    )


def _pr_scanned(spark, sf_dir) -> DataFrame:
    return review.pr_scan_join(_pr_events(spark, sf_dir), load(spark, sf_dir, "findings"))


@query
def pr_scan_join(spark, sf_dir):
    """Every pull request with its newest commit, and how many findings its repository shows there."""
    shown = _pr_scanned(spark, sf_dir).groupBy("repo").agg(F.count(F.lit(1)).alias("findings"))
    return review.pr_targets(_pr_events(spark, sf_dir)).join(shown, "repo")


@query
def pr_annotations(spark, sf_dir):
    return review.pr_annotations(_pr_scanned(spark, sf_dir), templates(spark)).select(
        "repo", "path", F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"), "annotation_level", "title", "message",
    )


@query
def pr_comments(spark, sf_dir):
    return review.pr_comments(_pr_scanned(spark, sf_dir), templates(spark)).select(
        "repo", "file", _line(), "body"
    )


# --- Whole audit ----------------------------------------------------------------------------


def _audit_files(spark, sf_dir) -> DataFrame:
    """Sources, tokens, Dockerfiles and manifests as one stored table of twenty repositories."""
    code = load(spark, sf_dir, "import_files")
    every = (
        code.unionByName(load(spark, sf_dir, "token_files"))
        .unionByName(load(spark, sf_dir, "docker_files"))
        .unionByName(load(spark, sf_dir, "pom_files"))
        .unionByName(load(spark, sf_dir, "pipfile_files"))
    )
    return stored(every.repartition(32, "repo", "path"), "files")


def _audit(spark, sf_dir) -> audit.Audit:
    return audit.run_audit(
        _audit_files(spark, sf_dir),
        vuln_db(spark),
        cwe_dim(spark),
        guidance(spark),
        policies=_policy_rows(spark, sf_dir),
        reports=[reports.ingest_bandit(load(spark, sf_dir, "bandit_reports"))],
    )


@query
def audit_findings(spark, sf_dir):
    """From files, reports and policies to scored findings."""
    return _audit(spark, sf_dir).scored.select(
        "repo", "file", _line(), "cwe", "rule", joined("detected_by"),
        F.col("confidence").cast("bigint").alias("confidence"), "reachable", "internet_exposed",
        F.col("risk_score").cast("double").alias("risk_score"), "severity", "sink", "fingerprint", "cve",
    )


@query
def audit_verdicts(spark, sf_dir):
    """From files, reports and policies to the gate."""
    return _audit(spark, sf_dir).verdicts.select(
        "repo", "critical", "high", "medium", "low", "gate_status", joined("gate_reasons", "; ")
    )


# --- Streams --------------------------------------------------------------------------------


def _stream(spark, sf_dir, name: str) -> DataFrame:
    """A given table as a stream of three batches, each of as many files as the table is read in parts."""
    rows = table(spark, sf_dir, name)
    path = fresh_path(spark, name)
    files = rows.rdd.getNumPartitions()
    rows.repartition(3 * files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query
def stream_scan(spark, sf_dir):
    documents_stream = _stream(spark, sf_dir, "documents")
    files = file_sources.documents_as_files(documents_stream)
    out, checkpoint = fresh_path(spark, "stream-scan"), fresh_path(spark, "checkpoint")
    stream_scan_job.start_stream_scan(files, out, checkpoint).awaitTermination()
    schema = stream_scan_job.stream_scan(file_sources.documents_as_files(table(spark, sf_dir, "documents"))).schema
    return _secret_columns(audit.line_findings(spark.read.schema(schema).parquet(out)))


@query
def stream_gate(spark, sf_dir):
    files = file_sources.documents_as_files(_stream(spark, sf_dir, "documents"))
    policies = _policies(spark, sf_dir)
    out, checkpoint = fresh_path(spark, "stream-gate"), fresh_path(spark, "checkpoint")
    stream_scan_job.start_stream_gate(files, policies, out, checkpoint).awaitTermination()
    verdicts = stream_scan_job.current_verdicts(spark.read.parquet(f"{out}/verdicts"))
    return verdicts.select("repo", "critical", "high", "medium", "low", "gate_status", joined("gate_reasons", "; "))


@query
def stream_gate_changes(spark, sf_dir):
    """The gate over three batches: every file, then mended and deleted files and new manifests, then files that return."""
    docs = table(spark, sf_dir, "documents")
    doc, columns = F.col("doc_id"), ["repo", "path", "size", "content", "deleted"]

    def code(rows: DataFrame, content: Column, deleted: bool) -> DataFrame:
        given = file_sources.documents_as_files(rows).withColumn("content", content)
        return given.withColumn("deleted", F.lit(deleted)).select(columns)

    def manifests(rows: DataFrame, content: str | None) -> DataFrame:
        return rows.select(
            F.col("source").alias("repo"), F.concat(F.lit("m"), doc.cast("string"), F.lit("/requirements.txt")).alias("path"),
            F.lit(0).cast("bigint").alias("size"), F.lit(content).cast("string").alias("content"), F.lit(content is None).alias("deleted"),
        )

    text, none = F.col("content"), F.lit(None).cast("string")
    batches = [
        code(docs, text, False),
        code(docs.filter(doc % 3 == 0), F.lit("x = 1\n"), False)
        .unionByName(code(docs.filter(doc % 3 == 1), none, True))
        .unionByName(manifests(docs.filter(doc % 5 == 0), "django==2.0\n")),
        code(docs.filter(doc % 6 == 1), text, False)
        .unionByName(manifests(docs.filter(doc % 10 == 0), "django==9.0\n"))
        .unionByName(manifests(docs.filter(doc % 15 == 5), None)),
    ]
    path = fresh_path(spark, "changes")
    policies = stored(_policies(spark, sf_dir), "policies")
    out, checkpoint = fresh_path(spark, "stream-gate"), fresh_path(spark, "checkpoint")
    for batch in batches:  # what a run finds new is its batch, whatever the number of files
        batch.write.mode("append").parquet(path)
        stream = spark.readStream.schema(batches[0].schema).parquet(path)
        stream_scan_job.start_stream_gate(stream, policies, out, checkpoint, vuln_db(spark), compact=2).awaitTermination()
    verdicts = stream_scan_job.current_verdicts(spark.read.parquet(f"{out}/verdicts"))
    return verdicts.select("repo", "critical", "high", "medium", "low", "gate_status", joined("gate_reasons", "; "))


@query
def stream_pr_events(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    event = F.col("event_id")
    body = F.to_json(
        F.struct(
            (event % 50).alias("number"),
            F.struct(F.concat(F.lit("repo"), (F.col("user_id") % 10).cast("string")).alias("full_name")).alias("repository"),
            F.when(
                event % 5 != 0,
                F.struct(
                    F.struct(
                        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sha"), F.lit("main").alias("ref")
                    ).alias("head")
                ),
            ).alias("pull_request"),
        )
    )
    bodies = events.select("ts", body.alias("body"))
    verdicts = stored(_verdicts(spark, sf_dir).select("repo", "critical", "high", "medium", "low", "gate_status"), "verdicts")
    runs = stream_reviews.stream_pr_events(bodies, verdicts, "40 days")
    out, checkpoint = fresh_path(spark, "stream-pr"), fresh_path(spark, "checkpoint")
    (
        runs.select("repo", "pr_number", "commit_sha", "branch", "conclusion", "title", "summary")
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(out)


@query
def stream_latest(spark, sf_dir):
    scans = _stream(spark, sf_dir, "events").select(
        F.concat(F.lit("repo"), (F.col("user_id") % 10).cast("string")).alias("repo"),
        F.col("event_id").alias("ord"),
        "ts",
        F.col("event_type").alias("status"),
    )
    out, checkpoint = fresh_path(spark, "stream-latest"), fresh_path(spark, "checkpoint")
    stream_latest_job.start_stream_latest(scans, out, checkpoint).awaitTermination()
    return stream_latest_job.current_latest(spark, out).select("repo", "ord", "ts", "status")
