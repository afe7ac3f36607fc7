"""Facts about the code around a finding: its line, whether it is reachable, whether it is exposed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake import config
from auditlake.functions.labels import fingerprint as fingerprint_of
from auditlake.functions.text import split_lines, strip, suffix
from auditlake.operators.corpus import display_path, select_scan_sets, shows_exposure
from auditlake.skew import counted_join, lookup_join
from auditlake.sources.corpus_store import Corpus
from auditlake.workspace import stored

# Package names looked for in one pass over a file; more names become more groups.
PACKAGES_PER_GROUP = 500

# Name groups that are sent to every executor (some 50 MB); more are joined by a salted shuffle.
BROADCAST_GROUPS = 4000
FILE_SALTS = 256

# Line numbers looked up in one pass over a file; a file with more is passed over again.
LINES_PER_GROUP = 5000


def source_lines(wanted: DataFrame, files: DataFrame | Corpus) -> DataFrame:
    """Stripped text of the wanted lines: rows (repo, file, line, text).

    ``wanted`` is reduced to distinct line numbers per file, in groups of bounded size, so a file
    is read once however many findings it has, and only the wanted lines leave the join. The reduced
    table is written first: Spark then knows its size and shuffles the text of a plain table only if the wanted lines
    are too many to broadcast. The text of a ``Corpus`` is never shuffled.
    """
    per_file = stored(
        wanted.filter("line IS NOT NULL")
        .groupBy("repo", F.col("file").alias("path"), F.floor(F.col("line") / LINES_PER_GROUP).alias("line_group"))
        .agg(F.collect_set("line").alias("wanted_lines"))
        .drop("line_group"),
        "wanted-lines",
    )
    if isinstance(files, Corpus):
        joined = files.with_text(per_file)
        if files.rest is not None:
            joined = joined.unionByName(files.rest.select("repo", "path", "content").join(per_file, ["repo", "path"]))
    else:
        joined = files.select("repo", "path", "content").join(per_file, ["repo", "path"])
    lines = split_lines(F.col("content"))
    return (
        joined.select("repo", F.col("path").alias("file"), lines.alias("lines"), F.explode("wanted_lines").alias("line"))
        .filter(F.col("line").between(1, F.size("lines")))
        .select("repo", "file", "line", strip(F.get("lines", F.col("line") - 1)).alias("text"))
    )


def sink_lookup(findings: DataFrame, files: DataFrame | Corpus) -> DataFrame:
    """Add ``sink``, the text of the reported line ('' if there is none).

    Scanners of this package already carry the line; only rows without one are looked up, and only they are shuffled.
    """
    base = findings if "sink" in findings.columns else findings.withColumn("sink", F.lit(None).cast("string"))
    asked = base.filter("sink IS NULL")
    found = source_lines(asked.select("repo", "file", "line"), files)
    looked = (
        asked.join(found, ["repo", "file", "line"], "left")
        .withColumn("sink", F.coalesce(F.col("text"), F.lit("")))
        .drop("text")
    )
    return base.filter("sink IS NOT NULL").unionByName(looked).select(*looked.columns)


def fingerprint(findings: DataFrame) -> DataFrame:
    """Add the SHA-256 identity of each finding; the file enters as it is shown in reports."""
    shown = display_path(F.col("repo"), F.col("file"))
    return findings.withColumn(
        "fingerprint",
        fingerprint_of(F.col("repo"), shown, F.col("cwe"), F.coalesce(F.col("sink"), F.lit("")), F.col("line")),
    )


def exposure(files: DataFrame) -> DataFrame:
    """Per repository: does any eligible file show network exposure. Reduced before the shuffle."""
    mark = F.col("for_exposure") & shows_exposure(F.col("content"))
    return select_scan_sets(files).groupBy("repo").agg(
        F.coalesce(F.bool_or(mark), F.lit(False)).alias("internet_exposed")
    )


def package_mentions(
    wanted: DataFrame, files: DataFrame | Corpus, broadcast_groups: int = BROADCAST_GROUPS
) -> DataFrame:
    """Distinct (repo, package) of ``wanted`` whose name occurs in some code file of the repository.

    A ``Corpus`` finds the files to test by its postings and shuffles no text. For a plain table:
    A substring test has no join key, so the names come to the files: each repository's
    distinct names are packed into groups of bounded size, and a file row tests the names of
    a group in place and emits only those it contains. The groups are written and counted
    before the pass over the files is planned: up to a fixed number no file text is shuffled;
    beyond, the shuffle is salted by the file, so a repository with a large share of all files
    is spread.
    """
    if isinstance(files, Corpus):
        found = files.mentions(wanted)
        return found if files.rest is None else found.union(package_mentions(wanted, files.rest, broadcast_groups)).distinct()
    names = wanted.select("repo", F.lower("package").alias("package")).distinct()
    counts = names.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / PACKAGES_PER_GROUP).alias("groups"))
    groups = stored(
        names.join(counts, "repo")
        .groupBy("repo", F.pmod(F.xxhash64("package"), F.col("groups")).alias("name_group"))
        .agg(F.collect_list("package").alias("names"))
        .drop("name_group"),
        "package-names",
    )
    code = files.filter(suffix(F.col("path")).isin(config.REACHABILITY_EXTENSIONS)).select(
        "repo", "path", F.lower("content").alias("content")
    )
    matched = counted_join(code, groups, ["repo"], ["path"], broadcast_groups, FILE_SALTS).select(
        "repo",
        F.explode(F.filter("names", lambda n: F.contains(F.col("content"), n))).alias("package"),
    )
    return matched.distinct()


def reachability(findings: DataFrame, files: DataFrame | Corpus) -> DataFrame:
    """Add ``reachable``: a vulnerable package must be mentioned in code, all else is reachable.

    The mentions are written first: Spark then knows their size and does not shuffle all findings to meet a few of them.
    """
    package = F.lower(F.coalesce(F.col("package"), F.lit("")))
    asked = (F.col("cwe") == "CWE-1104") & (package != "")
    mentions = stored(package_mentions(findings.filter(asked).select("repo", "package"), files), "package-mentions")
    keyed = findings.withColumn("_name", F.when(asked, package))
    marked = lookup_join(
        keyed,
        mentions.select("repo", F.col("package").alias("_name"), F.lit(True).alias("_seen")),
        ["repo", "_name"],
        ["file", "line"],
    )
    reachable = F.col("_name").isNull() | F.coalesce(F.col("_seen"), F.lit(False))
    return marked.withColumn("reachable", F.when(reachable, "YES").otherwise("NO")).drop("_name", "_seen")
