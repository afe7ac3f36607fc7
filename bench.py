"""Headline queries on one scale, one JSON line.

Each query runs once to warm up (code generation, file cache) and once for the time. Results
are fully computed and dropped (noop sink).
"""

import json
import os
import sys
import time

HEADLINE = [
    "secret_scan", "secret_providers", "iac_dockerfile", "iac_kubernetes", "deps_requirements", "deps_pom",
    "extract_deps", "sca_match", "ingest_bandit", "ingest_osv", "ingest_ai_review", "dedup_findings",
    "risk_score", "gate", "report_summary", "sink_lookup", "fingerprint", "reachability", "exposure",
    "cwe_enrich", "template_join", "patch_apply", "sbom_components", "cyclonedx_export", "sarif_export",
    "pr_check_run", "pr_annotations", "latest_scan", "audit_findings", "stream_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from auditlake.session import session
    from workload.queries import QUERIES

    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - start

    times = {}
    for name in names:
        run(name)
        times[name] = round(run(name), 3)
        print(f"{name:20s} {times[name]:8.3f}", file=sys.stderr, flush=True)

    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(size(split(text, '\\n')))").first()[0]
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "secret_scan_lines_per_sec": round(lines / times["secret_scan"]) if "secret_scan" in times else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
