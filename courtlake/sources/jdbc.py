"""Database tables through Spark's JDBC source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, DataFrameWriter, SparkSession


@dataclass(frozen=True)
class Split:
    """How to read a table in parallel: ranges of a numeric or date column."""

    column: str
    lower: str
    upper: str
    parts: int


def table_reader(
    spark: SparkSession, url: str, table: str, properties: dict[str, str], split: Split | None
) -> DataFrameReader:
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if split is None:
        return reader
    return (
        reader.option("partitionColumn", split.column)
        .option("lowerBound", split.lower)
        .option("upperBound", split.upper)
        .option("numPartitions", split.parts)
    )


def read_table(
    spark: SparkSession, url: str, table: str, properties: dict[str, str], split: Split | None
) -> DataFrame:
    """A table, in the ranges of ``split``. With None, to be said outright, one task reads it all."""
    return table_reader(spark, url, table, properties, split).load()


def table_writer(df: DataFrame, url: str, table: str, properties: dict[str, str], parts: int | None) -> DataFrameWriter:
    writer = df.write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", table)
    writer = writer.option("truncate", True).options(**properties)
    return writer if parts is None else writer.option("numPartitions", parts)


def overwrite_table(
    df: DataFrame, url: str, table: str, properties: dict[str, str], parts: int | None = None
) -> None:
    """Replace the rows of a table; ``parts`` bounds the number of connections."""
    table_writer(df, url, table, properties, parts).save()
