"""Writing results: tables, JSON documents, appended rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.schemas import TABLES, conform


def append_table(rows: DataFrame, name: str, path: str) -> None:
    """Append rows to a stored table, in its column order."""
    conform(rows, TABLES[name]).write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, order: list[str] | None = None) -> None:
    """Replace a stored table. ``by`` makes folders; rows are spread by folder and ``order``, so a
    large folder gets several consecutive files and a small one a single file."""
    if not by:
        df.write.mode("overwrite").parquet(path)
        return
    sort = [*by, *(order or [])]
    spread = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    spread.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON document per row, NULL fields included."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(path)


def as_documents(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the whole row as JSON text, for a message queue or a document store."""
    return df.select(*keys, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("document"))
