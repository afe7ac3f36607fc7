"""The public weakness catalog as a table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read of an entry: its number, its name and its short description.
ENTRY = "_ID INT, _Name STRING, Description STRING"


def read_weaknesses(spark: SparkSession, path: str) -> DataFrame:
    """Rows (cwe_number, title, description) for ``cwe_enrich`` from catalog files in XML (one file, or a folder of them).

    The file is split among tasks by Spark; only ``Weakness`` elements are read, wherever they stand, not views and
    categories. Entries without a number are left out. Of a number given twice the smallest name and text stay, so a join never
    repeats a finding. A missing name or text is null (the enrichment has fixed replacements). A malformed entry fails the job.
    """
    entries = (
        spark.read.format("xml")
        .schema(ENTRY)
        .options(rowTag="Weakness", ignoreNamespace="true", mode="FAILFAST")
        .load(path)
    )
    return (
        entries.filter("_ID IS NOT NULL")
        .groupBy(F.col("_ID").alias("cwe_number"))
        .agg(F.min(F.struct(F.col("_Name").alias("title"), F.col("Description").alias("description"))).alias("entry"))
        .select("cwe_number", "entry.*")
    )
