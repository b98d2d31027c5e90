"""Result tables as Parquet, CSV or JSON, with stable schemas and replace-by-partition writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T, functions as F


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in schema order and type; absent ones become NULL, so every appended batch has the same layout."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def append_table(df: DataFrame, path: str, schema: T.StructType, partition_by: list[str] = ()) -> None:
    """Appends one batch; the commit protocol publishes a batch whole or not at all."""
    conform(df, schema).write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Rewrites only the partitions present in ``df`` (idempotent re-delivery of a segment)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One sub-folder per table."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{folder}/{name}")
