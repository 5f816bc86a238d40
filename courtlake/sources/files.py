"""Plain file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtlake.schemas import DAILY_DOCUMENT


def read_text_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV with a header, every column as text.

    Only the header line is read ahead. Files whose header differs fail rather than shift
    columns. ``multi_line`` admits line breaks inside quotes, at the price of unsplittable files.
    """
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )


def read_daily_documents(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Daily documents, one JSON object per file, or ``per_line``; a damaged one fails the job."""
    return spark.read.schema(DAILY_DOCUMENT).option("multiLine", not per_line).option("mode", "FAILFAST").json(path)


def write_daily_document(document: DataFrame, root: str, extraction_date: str) -> str:
    """Drop a day's document under its date."""
    path = f"{root}/daily_extracts/{extraction_date}"
    document.write.mode("overwrite").json(path)
    return path
