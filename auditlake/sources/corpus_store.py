"""A stored corpus for text lookups: files in buckets of (repo, path), and postings of the code files' trigrams.

A lookup writes what it wants with the same buckets, so the join moves no file text, however large the wanted side is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import config
from auditlake.functions.text import suffix
from auditlake.skew import lookup_join
from auditlake.workspace import fresh_path, stored

GRAM = 3
#: Characters of a text whose trigrams are gathered at once.
CHUNK = 1 << 16
#: Names tested in one pass over a file.
NAMES_PER_GROUP = 500


def bucketed(df: DataFrame, keys: list[str], buckets: int, label: str, path: str | None = None) -> DataFrame:
    """Write a table with a file per bucket of ``keys`` and read it back; joins with equal buckets need no exchange."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite")
        .option("path", path or fresh_path(spark, label)).saveAsTable(name)
    )
    return spark.table(name)


def grams(text: Column) -> Column:
    """Hashes of the distinct trigrams of a text; a hash met by chance only costs a test more."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    return F.transform(found, lambda g: F.hash(g))


def code_postings(files: DataFrame) -> DataFrame:
    """Rows (repo, gram, path) of code files, in one stateless pass over lower-cased text, chunk by chunk."""
    code = files.filter(suffix(F.col("path")).isin(config.REACHABILITY_EXTENSIONS)).select("repo", "path", F.lower("content").alias("content"))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("content"), F.lit(1)), F.lit(CHUNK))
    chunks = code.select("repo", "path", "content", F.explode(starts).alias("at")).select(
        "repo", "path", F.col("content").substr(F.col("at"), F.lit(CHUNK + GRAM - 1)).alias("chunk")
    )
    return chunks.select("repo", F.explode(grams(F.col("chunk"))).alias("gram"), "path")


@dataclass
class Corpus:
    """Files (repo, path, size, content) in buckets, postings of their code, and ``rest``: files without buckets, such as new ones."""

    text: DataFrame
    postings: DataFrame
    buckets: int
    rest: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.text.sparkSession

    def files(self) -> DataFrame:
        """All files as a table."""
        return self.text if self.rest is None else self.text.unionByName(self.rest.select(*self.text.columns))

    def plus(self, files: DataFrame) -> Corpus:
        """The corpus with further files (of other paths) that are not in buckets."""
        return Corpus(self.text, self.postings, self.buckets, files if self.rest is None else self.rest.unionByName(files))

    def with_text(self, wanted: DataFrame) -> DataFrame:
        """Rows (repo, path, ...) joined with the ``content`` of their bucketed file. Only ``wanted`` is shuffled, when it is written."""
        keyed = bucketed(wanted, ["repo", "path"], self.buckets, "wanted")
        return self.text.select("repo", "path", "content").join(keyed.hint("shuffle_hash"), ["repo", "path"])

    def mentions(self, wanted: DataFrame) -> DataFrame:
        """Distinct (repo, package) of ``wanted`` whose name, in lower case, occurs in some bucketed code file of the repository.

        The rarest trigram of a name selects files by the postings, and only those are tested; a name with a trigram that no file
        has is dropped. A name of one or two characters is tested in all code files of its repository.
        """
        names = stored(wanted.select("repo", F.lower("package").alias("package")).distinct(), "names")
        wide = names.filter(F.char_length("package") >= GRAM)
        parts = wide.select("repo", "package", F.explode(grams(F.col("package"))).alias("gram"))
        asked = bucketed(parts.select("repo", "gram").distinct(), ["repo", "gram"], self.buckets, "asked")
        counts = self.postings.join(asked.hint("shuffle_hash"), ["repo", "gram"]).groupBy("repo", "gram").agg(F.count("*").alias("files"))
        picked = (
            parts.join(counts, ["repo", "gram"], "left").groupBy("repo", "package")
            .agg(F.min_by("gram", F.struct("files", "gram")).alias("gram"), F.count(F.when(F.col("files").isNull(), True)).alias("missing"))
            .filter("missing = 0").drop("missing")
        )
        picked = bucketed(picked, ["repo", "gram"], self.buckets, "picked")
        found = self.postings.join(picked.hint("shuffle_hash"), ["repo", "gram"]).select("repo", "path", "package")
        code = self.text.filter(suffix(F.col("path")).isin(config.REACHABILITY_EXTENSIONS)).select("repo", "path")
        short = lookup_join(code, names.filter(F.char_length("package") < GRAM), ["repo"], ["path"], "inner")
        candidates = stored(found.unionByName(short.select("repo", "path", "package")).distinct(), "candidates")
        groups = candidates.groupBy("repo", "path").agg(F.ceil(F.count("*") / NAMES_PER_GROUP).alias("groups"))
        packed = (
            candidates.join(groups, ["repo", "path"])
            .groupBy("repo", "path", F.pmod(F.xxhash64("package"), F.col("groups")).alias("group"))
            .agg(F.collect_list("package").alias("names"))
            .drop("group")
        )
        text = F.lower("content")
        tested = self.with_text(packed).withColumn("content", text)
        return tested.select("repo", F.explode(F.filter("names", lambda n: F.contains(F.col("content"), n))).alias("package")).distinct()


def store_corpus(files: DataFrame, buckets: int, path: str | None = None) -> Corpus:
    """Store files (repo, path, size, content) for lookups. File text is moved here once; choose a bucket per 256 MB or so.

    The tables are declared in the session's catalog and their files lie below ``path`` (by default a folder that ``release``
    removes); ``open_corpus`` declares them again in another session.
    """
    spark = files.sparkSession
    base = path or fresh_path(spark, "corpus")
    text = bucketed(files.select("repo", "path", "size", "content"), ["repo", "path"], buckets, "corpus_text", f"{base}/text")
    postings = bucketed(code_postings(text).distinct(), ["repo", "gram"], buckets, "corpus_postings", f"{base}/postings")
    return Corpus(text, postings, buckets)


def open_corpus(spark: SparkSession, path: str, buckets: int) -> Corpus:
    """A corpus that ``store_corpus`` has written to ``path`` with so many buckets."""

    def declared(part: str, schema: str, keys: str) -> DataFrame:
        name = f"corpus_{part}_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}/{part}'")
        return spark.table(name)

    text = declared("text", "repo STRING, path STRING, size BIGINT, content STRING", "repo, path")
    return Corpus(text, declared("postings", "repo STRING, gram INT, path STRING", "repo, gram"), buckets)
