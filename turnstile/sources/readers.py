"""Reading the ticketing tables from files or a database with their declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnstile.schemas import ID, TABLES, Table, conform


def file_schema(table: Table, id_type: str = "string") -> StructType:
    """Schema for formats without one of their own (CSV, JSON): nothing is inferred."""
    return StructType.fromDDL(", ".join(f"`{c}` {id_type if t == ID else t}" for c, t in table.columns.items()))


def read_table(spark: SparkSession, name: str, path: str, format: str = "parquet", id_type: str = "string", **options) -> DataFrame:
    """A table with all its columns. Columns a parquet or ORC file lacks, because they were added
    to the model later, come as their defaults; so do missing values of columns with a default."""
    table = TABLES[name]
    reader = spark.read.options(**options)
    if format in ("csv", "json"):
        reader = reader.schema(file_schema(table, id_type))
    df = conform(reader.format(format).load(path), table)
    filled = [
        F.coalesce(F.col(c), F.lit(table.defaults[c]).cast(t)).alias(c) if c in table.defaults and c in table.required else F.col(c)
        for c, t in table.columns.items()
    ]
    return df.select(*filled)


def read_jdbc(
    spark: SparkSession, name: str, url: str, dbtable: str, split_by: str, bounds: tuple, partitions: int, **options
) -> DataFrame:
    """A table from a database, read in ``partitions`` parallel ranges of ``split_by``."""
    low, high = bounds
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=dbtable, partitionColumn=split_by, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(partitions), **options,
    )
    return conform(reader.load(), TABLES[name])
