"""JSON documents as ordered lines.

A document may be larger than one row or one task should hold, so it is never put together
in memory: it is a table of lines (repo, part, ord, tie, line). Written in that order, the lines
of a repository are its JSON document.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ORDER = ["repo", "part", "ord", "tie"]


def fixed_line(repos: DataFrame, part: int, text: Column, ord_type: str) -> DataFrame:
    """One line per repository, such as the opening or closing of a document."""
    return repos.select(
        "repo",
        F.lit(part).alias("part"),
        F.lit(None).cast(ord_type).alias("ord"),
        F.lit(None).cast("bigint").alias("tie"),
        text.alias("line"),
    )


def tagged(part: int, element: Column, key: Column | None = None) -> Column:
    """An element of a part at the row's ord. Of those with one key, only the one of the least ord is meant."""
    return F.struct(
        F.lit(part).alias("part"),
        (F.lit(None) if key is None else key).cast("string").alias("key"),
        F.to_json(element).alias("json"),
    )


def element_lines(rows: DataFrame, *elements: Column) -> DataFrame:
    """Lines of all ``tagged`` elements from one scan of the rows, with a comma before all but the first of a part.

    Elements are ordered by ord and, where that ties, by a hash of their text; equal elements
    are counted and repeated, so exactly one is the first. The first ones come from an
    aggregate and are joined on the whole order, which is one row per key: a repository with
    very many elements stays spread. The aggregate takes whole elements, so that Spark reuses the
    exchange under it instead of reading the rows again.
    """
    alone = F.col("key").isNull()
    stream = rows.select("repo", "ord", F.inline(F.array(*elements)))
    least = F.min(F.when(~alone, F.struct("ord", "json")))
    counted = (
        stream.withColumns({"at": F.when(alone, F.col("ord")), "same": F.when(alone, F.col("json"))})
        .groupBy("repo", "part", "key", "at", "same")
        .agg(least.alias("least"), F.count_if(alone).cast("int").alias("n"))
        .select(
            "repo",
            "part",
            F.coalesce("least.ord", "at").alias("ord"),
            F.coalesce("least.json", "same").alias("json"),
            F.greatest("n", F.lit(1)).alias("copies"),
        )
        .withColumn("tie", F.xxhash64("json"))
    )
    edge = F.min(F.struct("ord", "tie", "json", "copies"))
    first = counted.groupBy("repo", "part").agg(edge.alias("edge")).alias("first")
    c = counted.alias("c")
    # Null-safe equality: with the plain one Spark would filter only one side, which then is no longer the same.
    pairs = [(f"c.{k}", f"first.{k}") for k in ("repo", "part")] + [(f"c.{k}", f"edge.{k}") for k in ("ord", "tie", "json")]
    at_edge = reduce(Column.__and__, [F.col(own).eqNullSafe(F.col(edge)) for own, edge in pairs])
    copies = c.join(first, at_edge, "left").select(
        "c.*", F.col("edge").isNotNull().alias("first"), F.explode(F.sequence(F.lit(1), F.col("c.copies"))).alias("copy")
    )
    opens = F.col("first") & (F.col("copy") == 1)
    # The opening copy carries the smaller tie-break among equal elements.
    return copies.select(
        "repo",
        "part",
        "ord",
        F.when(opens, F.lit(-(2**63))).otherwise(F.col("tie")).alias("tie"),
        F.concat(F.when(opens, "").otherwise(","), F.col("json")).alias("line"),
    )


def write_documents(lines: DataFrame, path: str) -> None:
    """Write each repository's lines to its own folder; files in name order are the document.

    Rows are split by ranges of their order, so one large document is written by several tasks.
    """
    (
        lines.repartitionByRange(*ORDER)
        .sortWithinPartitions(*ORDER)
        .select("repo", "line")
        .write.mode("overwrite")
        .partitionBy("repo")
        .text(path)
    )
