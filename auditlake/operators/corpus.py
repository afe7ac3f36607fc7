"""Which files are scanned, and how their text becomes lines."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import config
from auditlake.functions.text import (
    base_name,
    contains_any,
    in_directory,
    once,
    split_lines,
    suffix,
)


def prune_ignored_dirs(files: DataFrame, ignored: list[str] = config.IGNORED_DIRS) -> DataFrame:
    """Drop files below an ignored directory (exact directory names, never the file name)."""
    return files.filter(~in_directory(F.col("path"), ignored))


def select_by_extension(
    files: DataFrame, extensions: list[str] = config.SUPPORTED_EXTENSIONS
) -> DataFrame:
    return files.filter(suffix(F.col("path")).isin(extensions))


def within(max_bytes: int | None) -> Column:
    """True up to the limit, the limit itself included; without a limit always."""
    return F.lit(True) if max_bytes is None else F.col("size") <= max_bytes


def size_limit(files: DataFrame, max_bytes: int | None) -> DataFrame:
    return files.filter(within(max_bytes))


def config_kind(path: Column, content: Column) -> Column:
    """Kind of configuration file, NULL if none; the first matching line decides."""
    name = F.lower(base_name(path))
    ext = suffix(path)
    text = F.lower(content)
    is_yaml = ext.isin(".yml", ".yaml")
    return (
        F.when((name == "dockerfile") | (ext == ".dockerfile"), "dockerfile")
        .when(name.isin("docker-compose.yml", "docker-compose.yaml"), "compose")
        .when(ext == ".tf", "terraform")
        .when(name == ".gitlab-ci.yml", "gitlab")
        .when((name == "jenkinsfile") | (ext == ".jenkinsfile"), "jenkins")
        .when(is_yaml & F.contains(path, F.lit(".github/workflows")), "github-actions")
        .when(
            is_yaml & F.contains(text, F.lit("apiversion:")) & F.contains(text, F.lit("kind:")),
            "kubernetes",
        )
        .when(is_yaml & F.contains(text, F.lit("awstemplateformatversion")), "cloudformation")
    )


def classify_config(files: DataFrame) -> DataFrame:
    return files.withColumn("kind", config_kind(F.col("path"), F.col("content")))


def select_scan_sets(files: DataFrame, max_bytes: int | None = None, workflows: bool = True) -> DataFrame:
    """Mark which scanners read a file. Only the path and the size are looked at.

    Without ``max_bytes`` files of any size are read; with it, ``scan_warnings`` lists what is left out. With
    ``workflows`` the configuration scanner sees workflow files although their directory ``.github`` is an ignored one;
    below any other ignored directory they stay unseen.
    """
    path, name, ext, kept = F.col("path"), F.col("_name"), F.col("_ext"), F.col("_kept")
    small = within(max_bytes)
    others = [d for d in config.IGNORED_DIRS if d != ".github"]
    workflow = F.contains(path, F.lit(".github/workflows")) & ~in_directory(path, others) & F.lit(workflows)
    source = ext.isin(config.SUPPORTED_EXTENSIONS)
    named = files.withColumns(
        {
            "_name": F.lower(base_name(path)),
            "_ext": suffix(path),
            "_kept": ~in_directory(path, config.IGNORED_DIRS),
        }
    )
    return named.withColumns(
        {
            "for_review": kept & source & small,
            "for_secrets": kept & (source | (name == ".env") | (ext == ".env")) & small,
            "for_dependencies": kept & name.isin(config.MANIFEST_NAMES),
            "for_config": (kept | workflow)
            & (
                name.isin("dockerfile", "jenkinsfile")
                | ext.isin(".dockerfile", ".jenkinsfile", ".tf", ".yml", ".yaml")
            ),
            "for_exposure": ext.isin(config.EXPOSURE_EXTENSIONS) | (name == "dockerfile"),
            "for_reachability": ext.isin(config.REACHABILITY_EXTENSIONS),
        }
    ).drop("_name", "_ext", "_kept")


def stage_filter(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files that a staged scan (scan_mode 'staged') would see."""
    path = F.col("path")
    ext = suffix(path)
    wanted = ext.isin(config.SUPPORTED_EXTENSIONS + config.STAGED_EXTENSIONS) | F.lower(
        base_name(path)
    ).isin(config.STAGED_NAMES)
    return size_limit(prune_ignored_dirs(files), max_bytes).filter(wanted)


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line with its 1-based number."""
    return files.select(
        "repo", F.col("path").alias("file"), F.posexplode(split_lines(F.col("content"))).alias("pos", "text")
    ).select("repo", "file", (F.col("pos") + 1).alias("line_no"), "text")


def review_candidates(files: DataFrame, n: int, max_bytes: int | None = None) -> DataFrame:
    """The first n reviewable files of each repository by path.

    Each task keeps its own n best rows per repository before the shuffle, so a repository
    with very many files sends only n rows per task.
    """
    reviewable = select_scan_sets(files, max_bytes).filter("for_review").select("repo", "path", "size")
    rank = F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    return reviewable.withColumn("rank", rank).filter(F.col("rank") <= n)


def scan_warnings(files: DataFrame, max_bytes: int | None) -> DataFrame:
    """One row per supported file that the limit keeps from being scanned."""
    skipped = select_by_extension(prune_ignored_dirs(files)).filter(~within(max_bytes))
    text = F.concat(
        F.lit("Skipped "),
        base_name(F.col("path")),
        F.lit(f" (exceeds size limit of {(max_bytes or 0) // (1 << 20)}MB)"),
    )
    return skipped.select("repo", "path", text.alias("warning"))


def scan_stats(files: DataFrame, findings: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Per repository: files scanned, files skipped for size, rows from each integration.

    The warnings themselves stay rows (``scan_warnings``); a repository may have any number.
    """
    flagged = select_scan_sets(files, max_bytes)
    too_large = (
        ~in_directory(F.col("path"), config.IGNORED_DIRS)
        & suffix(F.col("path")).isin(config.SUPPORTED_EXTENSIONS)
        & ~within(max_bytes)
    )
    per_repo = flagged.groupBy("repo").agg(
        F.count_if("for_review").alias("scanned_files"), F.count_if(too_large).alias("skipped_files")
    )
    scanner = F.col("ord.scanner")
    tools = findings.groupBy("repo").agg(
        F.count_if(scanner == config.SCANNER_RANK["bandit"]).alias("bandit"),
        F.count_if(scanner == config.SCANNER_RANK["codeql"]).alias("codeql"),
    )
    return per_repo.join(tools, "repo", "left").na.fill(0, ["bandit", "codeql"])


def display_path(repo: Column, path: Column) -> Column:
    """How a file is shown in reports: repository name, then the path inside it ('.' is the root)."""
    return F.when(path == ".", repo).otherwise(F.concat_ws("/", repo, path))


def shows_exposure(content: Column) -> Column:
    """True if this text shows that its repository listens to the network."""
    return once(F.lower(content), lambda low: contains_any(low, config.EXPOSURE_MARKERS))
