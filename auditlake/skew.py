"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def shuffled(side: DataFrame) -> DataFrame:
    """The side of a join that grows with the data, which must not be broadcast.

    Of a stored table Spark knows compressed bytes, before rows are repeated or arrays built: far less than the rows
    take in the driver.
    """
    return side.hint("merge")


def lookup_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join many rows to a table with few rows per key.

    The rows of a hot key are spread over ``salts`` join partitions by a hash of the
    ``spread_by`` columns (a hash, not a random number, so a retried task repeats it), and
    each key row is repeated once per salt. No hint is given: where the key table is small
    enough by Spark's own size check it is broadcast and nothing is shuffled; otherwise the
    shuffle is by key and salt and no task receives a whole hot key. A key table that grows
    with the data comes as ``shuffled``.
    """
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    repeated = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", spread).join(repeated, [*keys, "_salt"], how).drop("_salt")


def counted_join(
    rows: DataFrame,
    stored_table: DataFrame,
    keys: list[str],
    spread_by: list[str],
    broadcast_rows: int,
    salts: int,
) -> DataFrame:
    """Inner join of rows that are expensive to shuffle to a stored table of counted size.

    The table's rows are counted from its file footers. Up to ``broadcast_rows`` it is
    broadcast and the rows stay where they are; beyond, the join is salted.
    """
    if stored_table.count() <= broadcast_rows:
        return rows.join(F.broadcast(stored_table), keys)
    return lookup_join(rows, stored_table, keys, spread_by, "inner", salts)
