"""Rule and lookup tables as DataFrames.

Built-in tables are literal rows. Every operator that takes one also takes the user's own
table with the same columns; those may be any size and are joined without a hint, so Spark
decides from their real size whether to broadcast them.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from rows written in this package (known size, kept as a local relation)."""
    fields = StructType.fromDDL(schema)
    ordered = [{name: row[name] for name in fields.names} for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(ordered), schema=fields)
