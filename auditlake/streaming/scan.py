"""Scanning files as they arrive."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake.functions.labels import SEVERITIES
from auditlake.operators.findings import dedup_findings, finding_union
from auditlake.operators.sca import sca_match
from auditlake.operators.scoring import add_exposure, gate, risk_score
from auditlake.plans.audit import line_findings, manifest_deps, scan_pass
from auditlake.streaming.published import COMPACT, PublishedFolder, next_version, tables


STAGES = ["secret", "config", "root", "exposure"]
#: Buckets of repositories in the kept counts of a gate. A batch reads those that it touches.
BUCKETS = 256
#: What is counted of a file and of a repository: files that show exposure, findings per band if the repository is exposed and if not.
COUNTED = ["n_exposing", *[f"{s}_exposed" for s in SEVERITIES], *[f"{s}_hidden" for s in SEVERITIES]]
FILE_KEYS, REPO_KEYS = "repo STRING, file STRING", "repo STRING"


def stream_scan(files: DataFrame, manifests: bool = False) -> DataFrame:
    """Evidence of the line scanners for a stream of files. Stateless: every file stands alone.

    With ``manifests`` the text of dependency files is kept as well (column content).
    """
    found = scan_pass(files)
    if manifests:
        return found.filter(F.col("stage").isin([*STAGES, "manifest"]))
    return found.filter(F.col("stage").isin(STAGES)).drop("content")


def start_stream_scan(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the evidence of new files below ``out`` (files in the folder are processed once)."""
    return (
        stream_scan(files)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _unique(evidence: DataFrame, vulnerabilities: DataFrame | None) -> DataFrame:
    """Deduplicated findings; all count as reachable, as whether code names a package is not looked up in a stream."""
    found = line_findings(evidence)
    if vulnerabilities is not None:
        found = finding_union(found, sca_match(manifest_deps(evidence), vulnerabilities))
    return dedup_findings(found).withColumn("reachable", F.lit("YES"))


def score_evidence(evidence: DataFrame, vulnerabilities: DataFrame | None = None) -> DataFrame:
    """Scored findings of the line scanners, and with ``vulnerabilities`` of the dependencies in kept manifests."""
    exposed = (
        evidence.filter("stage = 'exposure'").select("repo").distinct().withColumn("internet_exposed", F.lit(True))
    )
    return risk_score(add_exposure(_unique(evidence, vulnerabilities), exposed))


def places(evidence: DataFrame, vulnerabilities: DataFrame | None = None) -> DataFrame:
    """What the rating of a file needs: a row per deduplicated finding, and one (without cwe) if the file shows exposure."""
    found = _unique(evidence, vulnerabilities).select("repo", "file", "cwe", "confidence", "reachable")
    exposing = evidence.filter("stage = 'exposure'").select("repo", "file").distinct()
    return found.unionByName(exposing, allowMissingColumns=True)


def file_counts(rows: DataFrame) -> DataFrame:
    """What each file adds to its repository: (repo, file, n_exposing, and findings per band if exposed and if not).

    ``rows`` are ``places``. Findings are deduplicated within a file, so files add up; only the exposure is the repository's, and a
    band depends on it. Files that add nothing have no row.
    """
    rated = risk_score(rows.withColumn("internet_exposed", F.explode(F.array(F.lit("YES"), F.lit("NO")))))
    known, shown = F.col("cwe").isNotNull(), F.col("internet_exposed") == "YES"
    return rated.groupBy("repo", "file").agg(
        F.count_if(~known & shown).alias("n_exposing"),
        *[F.count_if(known & shown & (F.col("severity") == s)).alias(f"{s}_exposed") for s in SEVERITIES],
        *[F.count_if(known & ~shown & (F.col("severity") == s)).alias(f"{s}_hidden") for s in SEVERITIES],
    )


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Signed rows folded per key; keys that have come to nothing are left out."""
    summed = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTED])
    return summed.filter(F.greatest(*[F.abs(c) for c in COUNTED]) > 0)


def start_stream_gate(
    files: DataFrame,
    policies: DataFrame,
    out: str,
    checkpoint: str,
    vulnerabilities: DataFrame | None = None,
    compact: int = COMPACT,
) -> StreamingQuery:
    """Evidence per batch, and new verdicts for the repositories a batch touched.

    The newest batch that brings a file replaces what was known of it, so a mended file no longer counts; rows of
    one file in the same batch count together. Where ``files`` has a column ``deleted``, a row with true is a
    tombstone: the file's findings no longer count (unless the same batch brings the file as well), and its content is not read.

    Kept are counts, not findings. A batch writes signed rows (repo, file, counts): what the files add now minus what
    they added before, and their sums per repository. The state of a file or a repository is the sum of its rows. Rows lie in buckets of
    repositories, and a batch reads the buckets it touches of one snapshot and fewer than ``compact`` tables of changes, each by its
    path, so neither its reading nor its listing grows with the number of batches; every ``compact`` batches all rows are folded
    into the next snapshot. Nothing counts until the pointer names it: a batch that failed half-way is written again, one that is
    published already changes nothing.
    """
    bucket = F.pmod(F.xxhash64("repo"), F.lit(BUCKETS)).cast("int")
    spark = files.sparkSession
    signed = ", ".join(f"{c} BIGINT" for c in COUNTED)

    def process(batch: DataFrame, batch_id: int) -> None:
        folder = PublishedFolder(spark, out)
        now = folder.pointer()
        if batch_id <= now["batch"]:
            return
        change = f"changes-{batch_id}"

        def keep(df: DataFrame, path: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{out}/{path}")
            return spark.read.schema(df.schema).parquet(f"{out}/{path}")

        def kept(names: list[str], part: str, keys: str) -> DataFrame:
            schema = f"{keys}, {signed}, bucket INT"
            if not names:
                return spark.createDataFrame([], schema)
            parts = [spark.read.schema(schema).parquet(f"{out}/{name}/{part}") for name in names]
            return reduce(DataFrame.unionByName, parts)

        def write(rows: DataFrame, path: str) -> None:
            by = F.col("file" if "file" in rows.columns else "repo")
            spread = rows.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64(by), F.lit(8)))
            spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/{path}")

        gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        evidence = keep(stream_scan(batch.filter(~gone).drop("deleted"), vulnerabilities is not None), f"evidence/batch={batch_id}")
        seen = keep(batch.select("repo", F.col("path").alias("file")).distinct(), f"{change}/seen")
        touched = keep(seen.select("repo").distinct(), f"{change}/touched")
        found = keep(places(evidence, vulnerabilities), f"{change}/places")
        buckets = [r[0] for r in touched.select(bucket).distinct().collect()]  # at most BUCKETS

        def before(part: str, keys: str) -> DataFrame:
            return kept(tables(now), part, keys).filter(F.col("bucket").isin(buckets)).drop("bucket")

        replaced = _sums(before("files", FILE_KEYS).join(seen, ["repo", "file"], "left_semi"), ["repo", "file"])
        minus = replaced.select("repo", "file", *[(-F.col(c)).alias(c) for c in COUNTED])
        write(_sums(minus.unionByName(file_counts(found)), ["repo", "file"]), f"{change}/files")
        write(_sums(kept([change], "files", FILE_KEYS), ["repo"]), f"{change}/repos")

        after = before("repos", REPO_KEYS).unionByName(kept([change], "repos", REPO_KEYS).drop("bucket"))
        totals = touched.join(_sums(after, ["repo"]), "repo", "left").na.fill(0)
        counts = totals.select(
            "repo",
            *[F.when(F.col("n_exposing") > 0, F.col(f"{s}_exposed")).otherwise(F.col(f"{s}_hidden")).alias(s) for s in SEVERITIES],
        )
        verdicts = gate(counts, policies.join(touched, "repo", "left_semi"))
        verdicts.write.mode("overwrite").parquet(f"{out}/verdicts/batch={batch_id}")

        snapshot = None
        if len(now["changes"]) + 1 >= compact:
            snapshot = f"snapshot-{batch_id}"
            every = [*tables(now), change]
            write(_sums(kept(every, "files", FILE_KEYS), ["repo", "file"]), f"{snapshot}/files")
            write(_sums(kept(every, "repos", REPO_KEYS), ["repo"]), f"{snapshot}/repos")
        folder.publish(next_version(now, batch_id, change, snapshot))
        folder.remove(now.get("old", []))

    return (
        files.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_verdicts(verdicts: DataFrame) -> DataFrame:
    """The newest verdict per repository from the batches written so far."""
    carried = [c for c in verdicts.columns if c not in ("repo", "batch")]
    return (
        verdicts.groupBy("repo")
        .agg(F.max_by(F.struct(*carried), "batch").alias("v"))
        .select("repo", "v.*")
    )
