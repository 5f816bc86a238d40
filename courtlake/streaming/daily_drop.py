"""Incremental load of the daily drop folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from courtlake.plans.daily_load import load_documents
from courtlake.schemas import DAILY_DOCUMENT
from courtlake.sources.tables import Tables


def load_new_documents(
    spark: SparkSession,
    drop: str,
    tables: Tables,
    checkpoint: str,
    now: Callable[[], dt.datetime] = dt.datetime.now,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Start loading the documents that arrived since the last run; stops when done.

    The stream checkpoint remembers the files. A batch that is run again after a failure adds
    nothing twice, because rows are appended by key. A game delivered late is simply absent so
    far, and is added.
    """
    stream = (
        spark.readStream.schema(DAILY_DOCUMENT)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(drop)
    )

    def load(batch: DataFrame, _: int) -> None:
        load_documents(batch, tables, now())

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(load)
        .start()
    )
