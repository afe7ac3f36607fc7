"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import numbered, running_totals, stored, word_count
from auditlake.skew import lookup_join

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """Per source (source, source_size): number, target.

    The sources, by code point and null last, have ``weights`` in turn and share ``share`` times all sizes. A target
    stops at ``epochs`` times the source's size and the rest goes to the others by weight until no target is above.
    The end of that repetition in one step: by size per weight, the stopped sources come first; after the last of them
    each of the others gets its weight times what is left per weight.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    rest = Window.orderBy("per_weight", "number")
    before = rest.rowsBetween(Window.unboundedPreceding, -1)
    onward = rest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = sizes.withColumn("number", F.row_number().over(turn)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1)
    )
    levelled = (
        ranked.withColumn("most", F.col("source_size") * epochs)
        .withColumn("per_weight", F.col("most") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("stopped", F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("level", (F.col("all_size") * F.lit(share) - F.col("stopped")) / F.sum("weight").over(onward))
    )
    water = levelled.where(F.col("level") <= F.col("per_weight")).agg(F.min_by("level", F.struct("per_weight", "number")).alias("water"))
    water = water.first()[0]  # null: every source is stopped
    target = F.col("most").cast("double") if water is None else F.least(F.col("most").cast("double"), F.col("weight") * F.lit(water))
    return levelled.select("source", "source_size", "number", target.alias("target"))


def mixed(
    rows: DataFrame, seed: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, exact: bool = True
) -> DataFrame:
    """Budget of each row (doc_id, source, size, any others): source_size, target, taken, copies.

    Within a source the rows are sorted by a hash of seed and doc_id (a draw that reruns repeat), and prefix sums of the
    sizes say which rows lie below the budget. Whole epochs come first, the rest is cut from one more. With ``exact`` the
    row at the cut gives only the words up to it (``taken`` adds up to the budget's whole words); otherwise a row is taken
    whole if its middle lies below the cut (``copies``). Null sources are one source, ties go by doc_id and row. A source
    without words has target 0 and takes nothing; no rows give no rows.
    """
    rows = stored(rows, "mix-sizes")  # texts are counted once
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    targets = source_targets(sizes, weights, share, epochs)
    # Null sources meet by a key that tells null from a text.
    key = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    keyed = lookup_join(
        rows.withColumn("_source", key), stored(targets.withColumn("_source", key).drop("source"), "source-targets"),
        ["_source"], ["doc_id", "size"], "inner",
    ).drop("_source")
    drawn = running_totals(keyed.withColumn("draw", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))),
                           ["draw", "doc_id"], ["size"], "number")
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("size_before")))
    once_more = (F.col("size_before") * 2 + F.col("size") <= left * 2) & (left > 0)
    copies = whole + once_more.cast("long")
    taken = whole * F.col("size") + part if exact else copies * F.col("size")
    return drawn.withColumn("taken", taken.cast("long")).withColumn("copies", copies.cast("int")).drop("draw", "size_before", "position", "number")


def mixture(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of the mix with all columns of ``docs``: each row as often as its source's epochs take it, whole texts."""
    rows = numbered(docs, F.col("doc_id"), F.col("source"), word_count().alias("size"), label="mix-rows")
    copies = mixed(rows.drop("row"), seed, exact=False).where("copies > 0").select("rid", "copies")
    return rows.join(copies, "rid").select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies")))).select("row.*")
